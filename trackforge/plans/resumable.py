"""Plans whose tables are kept: a step is skipped while what it is made of hasn't changed.

A step's fingerprint is that of its name, its settings, and the fingerprints of what it needs; an input's is that of its
files. Tables are written to folders of their own, and published by a manifest that is replaced as a whole; so a run that
breaks off leaves the steps that it finished, and readers see no half table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.operators import actions, islands, measures, windows
from trackforge.plans import match

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Step:
    """run gets the tables that the step needs, by name, and returns its own."""

    name: str
    needs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    settings: str = ""


class Files:
    """The few operations on files of any store that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside the file and renames, so that readers see the old text or the new one."""
        new = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(new), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(new), self.path(name)):
            raise OSError(f"{name} can't be replaced")

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def listing(self) -> list[str]:
        """Name, size and time of each file below the folder, in order; of the file itself if it is one."""
        out, found = [], self.fs.listFiles(self.path(""), True) if self.exists("") else None
        while found is not None and found.hasNext():
            f = found.next()
            out.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        return sorted(out)


def fingerprint(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def run_steps(spark: SparkSession, folder: str, inputs: dict[str, str], steps: list[Step], read: Callable[[SparkSession, str], DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """All tables by name, and the names of the steps that were written in this run.

    inputs: paths of tables, read by read (Parquet otherwise). steps stand in the order in which they can run. A step is
    written if its fingerprint is new, if its table is lost, or if a step that it needs has just been written.
    """
    files = Files(spark, folder)
    manifest: dict[str, dict[str, str]] = json.loads(files.text(MANIFEST)) if files.exists(MANIFEST) else {}
    read = read or (lambda s, path: s.read.parquet(path))
    tables = {name: read(spark, path) for name, path in inputs.items()}
    prints = {name: fingerprint(name, *Files(spark, path).listing()) for name, path in inputs.items()}
    written: list[str] = []
    for step in steps:
        prints[step.name] = fingerprint(step.name, step.settings, *(prints[n] for n in step.needs))
        before = manifest.get(step.name, {})
        kept = before.get("fingerprint") == prints[step.name] and files.exists(f"{before['folder']}/_SUCCESS")
        if not kept or set(step.needs) & set(written):
            name = f"{step.name}-{uuid.uuid4().hex[:12]}"
            step.run({n: tables[n] for n in step.needs}).write.parquet(f"{files.folder}/{name}")
            manifest[step.name] = {"fingerprint": prints[step.name], "folder": name}
            files.replace(MANIFEST, json.dumps(manifest, indent=1))
            if "folder" in before:
                files.drop(before["folder"])
            written.append(step.name)
        tables[step.name] = spark.read.parquet(f"{files.folder}/{manifest[step.name]['folder']}")
    return tables, written


def match_steps(s: match.Settings = match.Settings()) -> list[Step]:
    """The chain for matches as steps over the inputs detections and players (with teams)."""
    keys, a = match.KEYS, s.actions

    def outfield(players: DataFrame) -> DataFrame:
        return players.where("class = 'player' and team in (0, 1)").withColumn("x", F.col("x_m"))

    def segments(held: DataFrame) -> DataFrame:
        paced = windows.fitted_speed(held, ["match_id"], "frame", "t", "x", "y")
        control = paced.withColumn("team", F.when(F.coalesce(F.col("speed") <= a.fly_speed, F.lit(True)), F.col("controlled_by")))
        return islands.control_segments(control, keys, "frame", "t", "team", int(1000 * a.bridge_s), int(1000 * a.touch_s))

    def passes(t: dict[str, DataFrame]) -> DataFrame:
        held = t["possession"]
        flown = actions.flights(t["segments"], held.select(*keys, "frame", "x", "y"), keys, int(1000 * a.pass_gap)).join(t["directions"], [*keys, "team"])
        outs = held.where("ball_state = 'out' and x is not null").select(*keys, "t", "x", "y")
        return actions.passes(flown, outs, keys, a, s.pitch, F.col("right"), 0.05, int(1000 * a.pass_gap))

    how = repr(s)
    return [
        Step("ball", ("detections",), lambda t: match.ball_track(t["detections"], s), how),
        Step("possession", ("ball", "players"), lambda t: match.possession(t["ball"], t["players"], s), how),
        Step("directions", ("players",), lambda t: measures.attack_directions(outfield(t["players"]), keys, "team", "x")),
        Step("kickoffs", ("ball", "players"), lambda t: match.kickoff_events(t["ball"], t["players"], s), how),
        Step("tracks", ("players",), lambda t: match.player_tracks(t["players"], s), how),
        Step("goals", ("detections", "ball", "players", "directions", "kickoffs"), lambda t: match.goal_events(t["detections"], t["ball"], t["players"], t["directions"], t["kickoffs"], s)["goals"], how),
        Step("sequences", ("possession",), lambda t: match.figures(t["possession"], s)["sequences"], how),
        Step("segments", ("possession",), lambda t: segments(t["possession"]), how),
        Step("passes", ("segments", "possession", "directions"), passes, how),
    ]
