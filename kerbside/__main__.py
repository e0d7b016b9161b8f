"""Jobs on tables and documents: `python -m kerbside <job> --help`.  Tables are Parquet; a report goes to the screen as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import evaluation, lane_graph, matching, motion_field, pipelines, sequences, summaries, tracking, turns
from .sources import calibration, cameras, replay, roads


def _tracks(a) -> list[str]:
    return a.by.split(",")


def flatten(spark: SparkSession, a) -> DataFrame:
    """Objects of replay documents as a table."""
    return replay.objects(replay.read(spark, a.replays), located=not a.all)


def summary(spark: SparkSession, a) -> DataFrame:
    """Distinct objects, detections and mean speed by camera."""
    return summaries.camera_summary(spark.read.parquet(a.detections), spark.read.parquet(a.cameras))


def fragments(spark: SparkSession, a) -> DataFrame:
    """How broken the tracks of each camera are."""
    return summaries.fragmentation(spark.read.parquet(a.tracks), a.fps)


def links(spark: SparkSession, a) -> DataFrame:
    """Links of a lane map or of a saved street map response."""
    return roads.ways(spark, a.map, a.zone, (a.east, a.north)) if a.streets else roads.lines(roads.read_features(spark, a.map), a.layer, a.zone, (a.east, a.north))


def mapmatch(spark: SparkSession, a) -> DataFrame:
    """Tracks on links: link_id, s, d."""
    return matching.match_tracks(spark.read.parquet(a.tracks), spark.read.parquet(a.links), _tracks(a), a.method)


def snap(spark: SparkSession, a) -> DataFrame:
    """Rows moved to lane centres."""
    return matching.snap(spark.read.parquet(a.tracks), spark.read.parquet(a.links), _tracks(a), lane_width=a.lane_width)


def turn_counts(spark: SparkSession, a) -> DataFrame:
    """Turning movements between links, with intervals."""
    moves = turns.transitions(spark.read.parquet(a.states), _tracks(a), ["frame"])
    return turns.turn_table(moves, turns.link_ends(spark.read.parquet(a.links)) if a.links else None)


def field(spark: SparkSession, a) -> DataFrame:
    """Speed by link and bin."""
    per_track = motion_field.track_medians(motion_field.pair_speeds(spark.read.parquet(a.states), _tracks(a), a.fps), _tracks(a))
    return motion_field.build(per_track, lane_graph.ends(spark.read.parquet(a.links)).select("link_id", "length"))


def split(spark: SparkSession, a) -> DataFrame:
    """Tracks cut at impossible speeds."""
    return sequences.split_on_jumps(sequences.timeline(spark.read.parquet(a.tracks), a.fps), _tracks(a), ["frame"], a.limit)


def retrack(spark: SparkSession, a) -> DataFrame:
    """Placed detections tracked anew on the ground."""
    return tracking.track(spark.read.parquet(a.detections), a.fps)


def reproject(spark: SparkSession, a) -> DataFrame:
    """Objects placed, smoothed and boxed anew from their boxes."""
    sizes = calibration.priors(spark, a.priors).where(F.col("set") == a.set)
    return pipelines.reproject(spark.read.parquet(a.objects), calibration.flat(calibration.read(spark, a.calibrations)), sizes, a.fps)


def evaluate(spark: SparkSession, a) -> dict:
    """Detection and tracking quality against ground truth."""
    truth, found = spark.read.parquet(a.truth), spark.read.parquet(a.found)
    return evaluation.detection_metrics(truth, found, a.threshold) | evaluation.tracking_metrics(truth, found, a.threshold)


def directory(spark: SparkSession, a) -> DataFrame:
    """Cameras of saved service responses in an area."""
    return cameras.read_response(spark, a.responses, tuple(map(float, a.box.split(","))) if a.box else None, a.need_url)


def load(spark: SparkSession, a) -> dict:
    """Rows of some cameras replace theirs in a table."""
    names = a.cameras.split(",")
    sinks.replace_cameras(spark.read.parquet(a.rows), a.table, names)
    return {"cameras": names}


def rename(spark: SparkSession, a) -> dict:
    """Cameras renamed in tables."""
    return sinks.rename_tables(spark, a.tables, dict(x.split("=", 1) for x in a.names.split(",")), dry=a.dry)


#: Each job, its options that must be given, and those with a default.
JOBS = {
    flatten: (["replays"], {"all": False}),
    summary: (["detections", "cameras"], {}),
    fragments: (["tracks"], {"fps": 30.0}),
    links: (["map"], {"zone": 52, "layer": "A2_LINK", "streets": False, "east": 0.0, "north": 0.0}),
    mapmatch: (["tracks", "links"], {"by": "cctv_id,track_id", "method": "lock"}),
    snap: (["tracks", "links"], {"by": "cctv_id,track_id", "lane_width": 3.5}),
    turn_counts: (["states"], {"links": "", "by": "cctv_id,track_id"}),
    field: (["states", "links"], {"by": "cctv_id,track_id", "fps": 30.0}),
    split: (["tracks"], {"by": "cctv_id,track_id", "fps": 30.0, "limit": 200.0}),
    retrack: (["detections"], {"fps": 30.0}),
    reproject: (["objects", "calibrations", "priors"], {"set": "base", "fps": 30.0}),
    evaluate: (["truth", "found"], {"threshold": 0.5}),
    directory: (["responses"], {"box": "", "need_url": False}),
    load: (["rows", "table", "cameras"], {}),
    rename: (["names"], {"dry": False}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m kerbside", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    for job, (needed, defaults) in JOBS.items():
        p = jobs.add_parser(job.__name__.replace("_", "-"), help=job.__doc__)
        p.set_defaults(run=job)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        for name, value in defaults.items():
            flag = f"--{name.replace('_', '-')}"
            p.add_argument(flag, action="store_true") if isinstance(value, bool) else p.add_argument(flag, default=value, type=type(value))
        if job is rename:
            p.add_argument("tables", nargs="+")
        p.add_argument("--out", help="a path for the table; without it twenty rows are shown")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"kerbside {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    got = a.run(spark, a)
    if isinstance(got, dict):
        print(json.dumps(got))
    elif a.out:
        got.write.mode("overwrite").parquet(a.out)
    else:
        got.show(20, truncate=False)


if __name__ == "__main__":
    main()
