"""Command line: ``python -m statespan perft N [--divide] [--fen F]``, ``moves``, ``show``, ``reach N``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statespan.functions import position
from statespan.operators import moves, reach


def run(spark: SparkSession, arguments: list[str] | None = None) -> list[str]:
    """The lines that a command prints; a FEN that is none raises."""
    parser = argparse.ArgumentParser(prog="statespan")
    parser.add_argument("command", choices=["perft", "moves", "show", "reach"])
    parser.add_argument("depth", nargs="?", type=int, default=1)
    parser.add_argument("--divide", action="store_true")
    parser.add_argument("--fen", default=position.START_FEN)
    parser.add_argument("--after", default="", help="UCI moves to make first, parted by commas")
    given = parser.parse_args(arguments)
    rows = position.positions(spark.createDataFrame([(given.fen,)], "fen string")).drop("fen")
    if rows.where("board is null").count():
        raise ValueError(f"no FEN of this game: {given.fen}")
    rows = moves.play(rows, [m for m in given.after.split(",") if m])
    if given.command == "show":
        return rows.select(position.show(F.col("board")).alias("s")).first().s.split("\n")
    if given.command == "moves":
        return [r.uci for r in moves.successors(rows, []).orderBy("uci").collect()]
    if given.command == "reach":
        return [f"{r.step} {r.new} {r.cumulative}" for r in reach.ladder(reach.reachable(rows, given.depth)).orderBy("step").collect()]
    if given.divide:
        return [f"{r.uci} {r.nodes}" for r in reach.divide(rows, given.depth).orderBy("uci").collect()]
    return [str(reach.perft(rows, given.depth).first().nodes)]


if __name__ == "__main__":
    print("\n".join(run(SparkSession.builder.getOrCreate())))
