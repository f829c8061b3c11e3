"""SQL functions and views (U-01, U-02, U-05); they stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dimensions as D

#: Views over the tables of a catalogue, by which every operator's input is reachable from SQL.
VIEWS = ("tracks", "variants", "frames", "mixes", "mix_tracks", "latency")


def register_functions(spark: SparkSession) -> None:
    """``camelot_score(a, b)``, ``stretch_penalty(bpm, g)``, ``band_of(bpm)``, ``beats_to_seconds(b, bpm)``."""
    bands = " ".join(f"WHEN bpm >= {a - 0.5} AND bpm < {b + 0.5} THEN '{n}'" for n, (a, b) in D.BANDS.items())
    number = "CAST(regexp_extract({}, '^([0-9]+)', 1) AS INT)"
    gap = f"abs({number.format('a')} - {number.format('b')})"
    d = f"least({gap}, 12 - {gap})"
    for text in (
        f"band_of(bpm DOUBLE) RETURNS STRING RETURN CASE {bands} END",
        f"stretch_penalty(bpm DOUBLE, g INT) RETURNS DOUBLE RETURN least(1.0D, abs(g / bpm - 1) / {D.MOST_STRETCH}D)",
        "beats_to_seconds(b INT, bpm INT) RETURNS DOUBLE RETURN coalesce(b * 60.0D / nullif(bpm, 0), 0.0D)",
        f"""camelot_score(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN right(a, 1) = right(b, 1)
            THEN CASE WHEN {d} = 0 THEN 1.0D WHEN {d} = 1 THEN 0.8D WHEN {d} = 2 THEN 0.4D ELSE greatest(0.0D, 0.25D - 0.05D * ({d} - 3)) END
            ELSE CASE WHEN {d} = 0 THEN 0.8D WHEN {d} = 1 THEN 0.35D ELSE 0.1D END END""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


def register_recommend(recommendations: DataFrame) -> None:
    """``recommend(track, k)``: a table function over ranked recommendations."""
    recommendations.createOrReplaceTempView("recommendations")
    recommendations.sparkSession.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION recommend(track STRING, k INT) RETURNS TABLE(b_id STRING, score DOUBLE, rank INT) RETURN SELECT b_id, score, rank FROM recommendations WHERE a_id = track AND rank <= k"
    )


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
