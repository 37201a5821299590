"""Small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Weights (other, accuracy, instruction) of tasks that differ from the default (0, 0.8, 0.2).
# The spelling of names is part of the data.
WEIGHTS = {
    "Vehicle_Recognition": (0.3, 0.5, 0.2),
    "VRU_Recognition": (0.3, 0.5, 0.2),
    "Obstruction_Recognition": (0.3, 0.5, 0.2),
    "Sign_Sign_Relation": (0.3, 0.5, 0.2),
    "Sign_Lane_Relation": (0.3, 0.5, 0.2),
    "Light_Lane_Relation": (0.3, 0.5, 0.2),
    "Lane_Speed_Relation": (0.3, 0.5, 0.2),
    "Lane_Change_Relation": (0.3, 0.5, 0.2),
    "VRU_Cutin": (0.7, 0.1, 0.2),
    "Vehicle_Cutin": (0.7, 0.1, 0.2),
    "VRU_Cross": (0.7, 0.1, 0.2),
    "Key_Obsturction_Detection": (0.8, 0.0, 0.2),
    "Risk_Prediction": (0.7, 0.1, 0.2),
    "Spatial_Temporal_Reasoning": (0.4, 0.4, 0.2),
}

# Tasks of each family of marks; all others are choices.
FAMILIES = {
    "grounding": ["Vehicle_Recognition", "VRU_Recognition", "Obstruction_Recognition"],
    "relation": ["Light_Lane_Relation", "Sign_Sign_Relation", "Sign_Lane_Relation"],
    "lane_change": ["Lane_Change_Relation"],
    "speed": ["Lane_Speed_Relation"],
    "judge": ["VRU_Cutin", "Vehicle_Cutin", "VRU_Cross", "Key_Obsturction_Detection", "Spatial_Temporal_Reasoning", "Risk_Prediction"],
    "choice": [
        "Pavement_Marking", "Traffic_Sign", "Traffic_Light", "Right_Of_Way", "Light", "Weather", "Lane_Recognition", "Vehicle_Status", "Long_Short_Parking", "Vehicle_Bahavior", "VRU_Bahavior", "Drive_Efficiency",
        "Longitudinal", "Lateral",
    ],
}


def task_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *w) for t, w in WEIGHTS.items()], "task string, w_other double, w_accuracy double, w_instruction double")


def task_families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f) for f, ts in FAMILIES.items() for t in ts], "task string, family string")
