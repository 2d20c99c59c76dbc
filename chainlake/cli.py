"""A command for each thing an operator asks of a stored journal; every one prints a DataFrame.

    python -m chainlake.cli read --data DIR [--journal HEX] [--from E:S] [--to E:S] [--author HEX] [--kind K]
    python -m chainlake.cli head|status|doctor|members|journals|verify --data DIR
    python -m chainlake.cli queue --data DIR
    python -m chainlake.cli settings-schema

members, journals and doctor fold the control chain that the folder holds. What changes a store (init, append, settings
set, admit) needs a node that signs; here those are DataFrame operations, see operators/writing.py.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import hex_id
from .operators import chain, control, membership, reads, settings
from .sources.segment import read_queue, read_segments


def position(text: str) -> tuple[int, int]:
    epoch, _, seq = text.partition(":")
    return int(epoch), int(seq)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chainlake")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("read", "head", "status", "doctor", "members", "journals", "verify", "queue"):
        s = sub.add_parser(verb)
        s.add_argument("--data", required=True)
        s.add_argument("--permissive", action="store_true")
        if verb == "read":
            s.add_argument("--journal", type=bytes.fromhex)
            s.add_argument("--from", dest="first", type=position)
            s.add_argument("--to", dest="last", type=position)
            s.add_argument("--author", type=bytes.fromhex)
            s.add_argument("--kind")
    sub.add_parser("settings-schema")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    if a.verb == "settings-schema":
        return settings.schema_markdown(spark).orderBy("key_index")
    if a.verb == "queue":
        queued = read_queue(spark, a.data)
        return queued.select(hex_id(F.col("journal")).alias("journal"), hex_id(F.col("author")).alias("author"), "author_seq", "kind", "payload_len", "arrival")
    slots = read_segments(spark, a.data, "PERMISSIVE" if a.permissive else "FAILFAST")
    if a.verb == "read":
        rows = reads.read(slots, a.journal, a.first, a.last, a.author, a.kind)
        named = rows.withColumn("author", hex_id(F.col("author"))).withColumn("journal", hex_id(F.col("journal")))
        return reads.projection(reads.in_order(named))
    named = slots.withColumn("journal", hex_id(F.col("journal")))
    if a.verb == "head":
        return reads.heads(named)
    if a.verb == "status":
        return reads.journals(named).join(reads.heads(named, "slot_ts_ms"), "journal")
    if a.verb == "verify":
        return control.stored_continuity(slots).groupBy(hex_id(F.col("journal")).alias("journal"), "refusal").agg(F.count("*").alias("n"))
    folded = control.fold(control.from_store(slots))
    members = control.members(folded).select("cluster", hex_id(F.col("member")).alias("member"), "address", "joined_epoch", "joined_seq")
    if a.verb == "members":
        now = control.current_leaders(control.terms(folded)).select("cluster", hex_id(F.col("leader")).alias("leader"))
        return membership.listing(members, now)
    if a.verb == "journals":
        return control.journals(folded).withColumn("journal", hex_id(F.col("journal")))
    return chain.doctor(named, members, control.terms(folded).select("epoch"))


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("chainlake").getOrCreate()
    run(spark, argv if argv is not None else __import__("sys").argv[1:]).show(1000, False)


if __name__ == "__main__":
    main()
