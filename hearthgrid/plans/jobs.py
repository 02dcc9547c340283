"""The three jobs from files to files."""

from hearthgrid.config import GEOMETRY, MODEL_ORDER, TARGET
from hearthgrid.layer import Layer
from hearthgrid.models import estimators as est
from hearthgrid.models.registry import ModelRegistry
from hearthgrid.operators import metrics
from hearthgrid.operators.columns import feature_names, union_layers
from hearthgrid.operators.prep import target_stats
from hearthgrid.plans.building_features import building_features
from hearthgrid.plans.clean_attributes import clean_attributes
from hearthgrid.plans.train_compare import leaderboard, score_models, train_models
from hearthgrid.session import materialize
from hearthgrid.sources.geojson import read_geojson, write_geojson
from hearthgrid.sources.sinks import write_predictions, write_table
from hearthgrid.sources.tables import read_table


def build_features(buildings, raster, pois, water, roads, output, areas=None, as_geojson=False, sides=None):
    """Job 1: the feature table of all buildings, as Parquet or GeoJSON."""
    out = building_features(buildings, raster, pois, water, roads, areas, sides=sides)
    if as_geojson:
        write_geojson(buildings.with_df(out), output)
    else:
        write_table(out, output)


def clean_file(spark, source, parquet, geojson=None, key="id", kind="polygon", properties=None,
               quantile=None, collection=False):
    """Job 2: attributes of a GeoJSON file, made numeric, as Parquet and optionally GeoJSON."""
    df = read_geojson(spark, source, kind, properties, GEOMETRY, collection=collection)
    out = clean_attributes(df, quantile=quantile)
    write_table(out, parquet)
    if geojson is not None:
        # From the table just written, so that nothing is worked out twice.
        write_geojson(Layer(read_table(spark, parquet), key, GEOMETRY, kind, 4326), geojson)


def train_file(spark, source, models, results, key="id", names=MODEL_ORDER, search=True):
    """Job 3: train, score and compare on a numeric table; everything it reports is written.

    Below ``results``: predictions with errors and feature importances per model, the leaderboard,
    the target summary, and the density table and bounds for a chart per model.
    """
    df = read_table(spark, source).drop(GEOMETRY)
    trained = train_models(df, key, ModelRegistry(spark, models), names, search=search)
    scored = materialize(score_models(trained, df, key), "scored")
    shares = [est.importances(m.stages[-1], feature_names(df.drop(key)), name)
              for name, m in trained.items() if hasattr(m.stages[-1], "featureImportances")]
    write_predictions(scored.drop("is_test"), results, union_layers(*shares) if shares else None)
    write_table(leaderboard(scored), f"{results}/leaderboard")
    write_table(target_stats(df, TARGET), f"{results}/target")
    write_table(metrics.hex_density(scored), f"{results}/density")
    write_table(metrics.plot_bounds(scored), f"{results}/bounds")
    return trained
