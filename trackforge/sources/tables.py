"""Readers of match folders. Many matches are one table: the folder's name becomes match_id.

CSV files are read with their schema; nothing is inferred. Filters on half and time reach the scan when the tables
have been written as Parquet by sinks.write_table, which partitions by match and half and sorts by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge import schema

FILES = {"detections": schema.DETECTIONS, "ball": schema.BALL, "teams": schema.TEAMS, "possession": schema.POSSESSION, "events": schema.EVENTS, "goals_auto": schema.GOALS, "actions": schema.ACTIONS, "tracks": schema.TRACKS, "players": schema.PLAYERS, "team_distance": schema.TEAM_DISTANCE}


def read_csv(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """CSV with a header; columns are found by name, and cells that are empty are null."""
    return spark.read.schema(kind).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all matches under root, with match_id from the folder and t where there is a time."""
    df = read_csv(spark, f"{root}/*/{name}.csv", FILES[name])
    df = df.withColumn("match_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return schema.with_ms(df) if "time_s" in df.columns else df


def ball_candidates(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("class") == "ball")


def people(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("class") != "ball")


def players_for_possession(teams: DataFrame) -> DataFrame:
    """Players with a team, unknown ones (-1) and goalkeepers among them."""
    return teams.where((F.col("class") == "player") & F.col("team").isNotNull())


def players_for_stats(teams: DataFrame) -> DataFrame:
    return teams.where((F.col("class") == "player") & F.col("team").isin(0, 1)).withColumn("gk", F.coalesce(F.col("gk") == 1, F.lit(False)))


def frames_of(teams: DataFrame, ball: DataFrame) -> DataFrame:
    """Every frame of either table once; where both have it, by the teams' time."""
    keys = ["match_id", "frame"]
    both = teams.select(*keys, "t", "half", F.lit(0).alias("r")).unionByName(ball.select(*keys, "t", "half", F.lit(1).alias("r")))
    return both.groupBy(*keys).agg(F.min(F.struct("r", "t", "half")).alias("f")).select(*keys, "f.t", "f.half")


def in_window(df: DataFrame, half: int, t0: float, t1: float) -> DataFrame:
    """Rows of a half from t0 to t1 seconds; on Parquet the filter skips files and row groups."""
    return df.where((F.col("half") == half) & F.col("time_s").between(t0, t1))


def passes_and_shots(actions: DataFrame) -> DataFrame:
    """Passes and shots with a flag for those that were inferred from a goal."""
    mark = r" \(inferred from the goal\)"
    return actions.where(F.col("type").isin("pass", "shot")).withColumn("inferred", F.coalesce(F.col("outcome").rlike(mark), F.lit(False))).withColumn("outcome", F.regexp_replace("outcome", mark, ""))


def read_json(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """A JSON document as one row; no rows if the file is missing."""
    text = spark.read.option("wholetext", True).text(path) if _exists(spark, path) else spark.createDataFrame([], "value string")
    parsed = F.from_json("value", kind if isinstance(kind, T.StructType) else T.ArrayType(kind.elementType))
    return text.select(F.explode(parsed).alias("x")).select("x.*") if isinstance(kind, T.ArrayType) else text.select(parsed.alias("x")).select("x.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def label_boxes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Label text files (class, centre, size as shares of the image) as pixel boxes; lines of other shapes are skipped."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    return boxes_of_lines(lines, width, height)


def boxes_of_lines(lines: DataFrame, width: int, height: int) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    v = [F.expr(f"try_cast(p[{i}] as double)") for i in range(5)]
    rows = lines.withColumn("p", p).where(F.size("p") == 5)
    return rows.select(*[c for c in lines.columns if c != "value"], v[0].cast("int").alias("class"), ((v[1] - v[3] / 2) * width).alias("x1"), ((v[2] - v[4] / 2) * height).alias("y1"), ((v[1] + v[3] / 2) * width).alias("x2"), ((v[2] + v[4] / 2) * height).alias("y2"))


def embedded_json(html: "F.Column", element: str) -> "F.Column":
    """Text of the script element with this id in a report; empty if there is none."""
    return F.regexp_extract(html, f'(?s)id="{element}"[^>]*>(.*?)</script>', 1)


def clicked_points(clicked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and line observations of clicked-point documents."""
    return clicked.select("image", F.inline("points")), clicked.select("image", F.inline("lines"))


def tidy_labels(sheet: DataFrame, item: list[str], labels: list[str]) -> DataFrame:
    """One row for each label column of a judgement sheet: analysis, label."""
    return sheet.unpivot(item, labels, "analysis", "label")


def half_rows(matches: DataFrame) -> DataFrame:
    """One row for each half of match configurations."""
    return matches.select("name", F.posexplode("halves").alias("i", "h")).select("name", (F.col("i") + 1).alias("half"), "h.start_s", "h.end_s")
