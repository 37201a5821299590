import duckdb
import pytest

import corpus_pipeline as C
from scorelake.llm import piece_viterbi, quality_fm
from scorelake.llm.common import table, written
from scorelake.llm.pieces import load
from scorelake.llm.queries import oracle_sql, queries
from tests.llm.helpers import DOCS, awkward, doc
from tests.llm.test_mix import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substring import brute
from tests.llm.helpers import WORD
from tests.test_queries import shape

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = queries()[name](spark, DATA).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and shape(got) == shape(want)


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, []
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, DATA), "test-stage")
        kept.append([tuple(r) for r in docs.collect()])
        if stage is not C.encoded:
            assert docs.columns == columns
    start = [tuple(r) for r in table(spark, DATA, "documents").collect()]
    model = quality_fm.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    plain = [r for r in start if quality_fm.sigmoid(quality_fm.FM(model.w0, model.w.astype("f4"), model.v.astype("f4")).margins(*quality_fm.pack([quality_fm.features(r[1], r[4])])))[0] >= 0.3]
    assert sorted(kept[0]) == sorted(plain)
    prints = [(r[0], brute_fingerprint(r[1])) for r in kept[0]]
    own = brute_components(prints)
    assert sorted(kept[1]) == sorted(r for r in kept[0] if own[brute_fingerprint(r[1])] == r[0])
    cut = {x[0]: x for x in brute([r[:2] for r in kept[1]], 13)}
    want = [(r[0], cut[r[0]][3] if cut[r[0]][2] else r[1]) for r in kept[1] if not (cut[r[0]][2] and not cut[r[0]][3])]
    assert sorted(r[:2] for r in kept[2]) == sorted(want) and all(r[4] == len(r[1]) for r in kept[2])
    sizes, times = {}, {}
    for r in kept[2]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    for r in kept[3]:
        times[r[0]] = times.get(r[0], 0) + 1
    goal = brute_targets(sizes)
    for s in sizes:
        given = [(times.get(r[0], 0), len(WORD.findall(r[1]))) for r in kept[2] if r[3] == s]
        assert abs(sum(n * w for n, w in given) - goal[s]) <= max(w for _, w in given) / 2 + 1 and all(n <= 3 for n, _ in given)
    assert {r[:2] for r in kept[3]} <= {r[:2] for r in kept[2]}
    pieces = load()
    text = {r[0]: r[1] for r in kept[3]}
    assert len(kept[4]) == len(kept[3])
    assert all(piece_viterbi.decode_ids(piece_viterbi.np.asarray(r[1]), pieces) == text[r[0]] and r[2] == len(r[1]) and r[3] == len(text[r[0]]) for r in kept[4])


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in ([*awkward(), *[doc(100 + k, f"plain words number {k} in a row of text") for k in range(5)]], []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in C.STAGES:
            docs = written(stage(spark, docs, DATA), "test-stage")
        assert docs.count() <= 3 * len(rows)


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns called as inner ones stay, with their values."""
    extra = {"_row": "r", "row": "q", "_cut": "c", "cut": "d", "_id": "i", "_keep": "k", "fp": "f", "component_id": "m"}
    rows = [(k, f"some plain words of text number {k % 3} here", "en", "s", 9, *extra.values()) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra))
    for _, stage in C.STAGES[1:4]:
        docs = written(stage(spark, docs, DATA), "test-stage")
        assert docs.columns[5:] == list(extra)
        assert all(r[c] == v for r in docs.collect() for c, v in extra.items())
    assert docs.count() > 0
    again = piece_viterbi.decode(piece_viterbi.encode(docs).selectExpr("*", "'x' as text"))
    assert again.columns == ["doc_id", "token_ids", "text", "text_1"] and again.where("text <> 'x' or text_1 not like 'some%'").isEmpty()
