"""Recovery of a session from what is left of it: an archived table, a local copy, or its live events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .sinks import fallback_beats, write_csv
from .tables import first_present, phone_beats, reference_beats, text_table


def archived_beats(spark: SparkSession, archive: str, local: str | None = None, events: DataFrame | None = None) -> DataFrame | None:
    """The reference monitor's beats of a session, as text: the table at archive; else the copy at local,
    which is archived; else the table rebuilt from live events (sinks.fallback_beats), which is archived
    too; None if there is nothing of it."""
    if not first_present(spark, [archive]):
        if local and first_present(spark, [local]):
            write_csv(text_table(spark, local), archive)
        elif events is not None and events.where("timestamp_ms is not null").limit(1).count():
            write_csv(fallback_beats(events), archive)
        else:
            return None
    return text_table(spark, archive)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder, on whatever file system; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def recovered(spark: SparkSession, phone: str, archive: str, local: str | None = None, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The phone's and the monitor's beats of a session that was cut short, ready to be merged. A missing
    phone table is an error that tells what else lies there, a monitor without any trace one that
    tells where it was looked for."""
    if not first_present(spark, [phone]):
        folder = phone.rpartition("/")[0]
        raise FileNotFoundError(f"{phone} is missing; there are: {', '.join(listed(spark, folder)) or 'no files'}")
    beats = archived_beats(spark, archive, local, events)
    if beats is None:
        raise FileNotFoundError(f"no beats of the monitor at {archive}" + (f" or {local}" if local else "") + ", and no events")
    return phone_beats(text_table(spark, phone)), reference_beats(beats)


def artifacts_present(spark: SparkSession, root: str, sessions: Sequence[str], needed: Sequence[str]) -> list[str]:
    """Those of the sessions below root that have all files needed; {session} in a name stands for the session."""
    return [s for s in sessions if set(x.format(session=s) for x in needed) <= set(listed(spark, f"{root}/{s}"))]
