"""Settings of the three jobs."""

# Fixed values -----------------------------------------------------------------
# Names, radii, grids and constants that have to be exactly these for the results
# to be comparable with earlier runs of the same study.

WGS84 = 4326
WEB_MERCATOR = 3857

POI_RADIUS = 500.0
WATER_RADIUS = 500.0
WATER_CENTRE_MARGIN = 100.0
ROAD_RADIUS = 500.0
# Corners of a search region drawn as a polygon; the default region is the circle around it.
BUFFER_SIDES = 64

TARGET = "peopleCount"
GEOMETRY = "geometry"
MISSING_LABEL = "MISSING"
TARGET_QUANTILE = 0.99

# Identifier and sex-age counts that would give the target away.
LEAK_COLUMNS = [
    "GlobalID", "count_w_all", "count_w_0_4", "count_w_5_9", "count_w_10_14", "count_w_15_19",
    "count_w_20_24", "count_w_25_29", "count_w_30_34", "count_w_35_39", "count_w_40_44",
    "count_w_45_49", "count_w_50_54", "count_w_55_59", "count_w_60_64", "count_w_65_69",
    "count_w_more_70", "count_m_all", "count_m_0_4", "count_m_5_9", "count_m_10_14",
    "count_m_15_19", "count_m_20_24", "count_m_25_29", "count_m_30_34", "count_m_35_39",
    "count_m_40_44", "count_m_45_49", "count_m_50_54", "count_m_55_59", "count_m_60_64",
    "count_m_65_69", "count_m_more_70"]

AREA_COLUMNS = ["FNAME", "Eng_Name", "OBJECTID"]
ROAD_WIDTH = "FWIDTH"
LAND_AREA = "LandArea"

TEST_SIZE = 0.15
SEED = 0
FOLDS = 5

MODEL_GRIDS = {
    "random_forest": {"n_estimators": [150], "max_features": ["sqrt"], "max_depth": [7],
                      "min_samples_leaf": [8]},
    "xgboost": {"n_estimators": [100, 150], "max_depth": [5, 7], "learning_rate": [0.05, 0.1],
                "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "gradient_boosting": {"n_estimators": [100, 150], "learning_rate": [0.05], "max_depth": [3],
                          "min_samples_leaf": [1]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
    "linear_regression": {},
}
MODEL_ORDER = ["random_forest", "lasso", "linear_regression", "xgboost", "gradient_boosting"]

LASSO_ALPHAS = 100
LASSO_PATH_RATIO = 1e-3

HEX_COLUMNS = 100
# ------------------------------------------------------------------------------
