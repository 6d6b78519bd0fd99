"""Search of an object map from the command line: text, nearest, near, on, position.

    python -m tesserae.plans.search_cli --map DIR TEXT [--nearest OTHER | --near OTHER | --on OTHER] [--position X Y Z]

DIR holds the tables nodes (run, node, label and box), objects (id, embedding) and texts (text, embedding), as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import search, spatial


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("text", nargs="?")
    p.add_argument("--map", required=True)
    p.add_argument("--nearest")
    p.add_argument("--near")
    p.add_argument("--on")
    p.add_argument("--position", nargs=3, type=float)
    p.add_argument("--top", type=int, default=5)
    return p


def check(args: argparse.Namespace) -> None:
    """At most one relation; --nearest needs a text; relations and a position exclude each other."""
    relations = [k for k in ("nearest", "near", "on") if getattr(args, k)]
    if len(relations) > 1:
        raise ValueError("only one of --nearest, --near and --on")
    if args.nearest and not args.text:
        raise ValueError("--nearest needs a text")
    if args.position and relations:
        raise ValueError("--position goes with a text only")
    if not (args.text or relations or args.position):
        raise ValueError("nothing to search for")


def by_text(nodes: DataFrame, objects: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """id, score, rank of all objects for a text that the table of texts has."""
    asked = texts.where(F.col("text") == text).select(F.lit(0).alias("query"), F.col("embedding").alias("q"))
    return search.rank(asked, objects).select("id", "score", "rank")


def answer(nodes: DataFrame, objects: DataFrame, texts: DataFrame, args: argparse.Namespace) -> DataFrame:
    """node, label, value, rank; value is a score, a gap or a distance."""
    check(args)
    label = lambda t: F.col("label") == t.strip().lower()
    named = nodes.select("node", "label")
    if args.position:
        found = spatial.at_position(nodes, tuple(args.position), args.top if not args.text else 1 << 30)
        found = found.join(named, "node")
        found = found.where(label(args.text)) if args.text else found
        return found.select("node", "label", F.col("distance").alias("value"), "rank").orderBy("rank").limit(args.top)
    if args.nearest:
        first = by_text(nodes, objects, texts, args.nearest).where("rank = 1").select(F.col("id").alias("node"))
        anchor = nodes.drop("label").join(first, "node", "left_semi")
        typed = named.where(label(args.text))
        if typed.isEmpty():
            best = by_text(nodes, objects, texts, args.text).where(F.col("rank") <= args.top)
            typed = named.join(best.select(F.col("id").alias("node")), "node", "left_semi")
        near = nodes.drop("label").join(typed.select("node"), "node", "left_semi")
        found = spatial.nearest(near, anchor, args.top).join(named, "node")
        return found.select("node", "label", F.lit(None).cast("double").alias("value"), "rank").orderBy("rank")
    if args.near or args.on:
        anchors = nodes.where(label(args.near or args.on))
        found = spatial.related(spatial.edges(nodes), anchors, "near" if args.near else "on").join(named, "node")
        if args.text:
            typed = found.where(label(args.text))
            if named.where(label(args.text)).isEmpty():
                ranked = by_text(nodes, objects, texts, args.text).select(F.col("id").alias("node"), "rank")
                return found.join(ranked, "node").select("node", "label", F.col("gap").alias("value"), "rank").orderBy("rank").limit(args.top)
            found = typed
        return found.select("node", "label", F.col("gap").alias("value"), F.lit(0).alias("rank")).orderBy("value", "node")
    best = by_text(nodes, objects, texts, args.text).where(F.col("rank") <= args.top)
    return best.select(F.col("id").alias("node"), F.col("score").alias("value"), "rank").join(named, "node").select("node", "label", "value", "rank").orderBy("rank")


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, text: label, centre, and what each object is on or under (near is left out)."""
    spot = F.format_string("%s at (%.2f, %.2f, %.2f)", "label", *[(F.col(f"l{k}") + F.col(f"h{k}")) / 2 for k in "xyz"])
    links = spatial.neighbours(edges).where("relation != 'near'")
    words = links.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "relation", "other"))), ", ").alias("links"))
    both = nodes.select("node", spot.alias("spot")).join(words, "node", "left")
    return both.select("node", F.concat_ws("; ", "spot", "links").alias("text"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("search").getOrCreate()
    tables = (spark.read.parquet(f"{args.map}/{t}") for t in ("nodes", "objects", "texts"))
    found = answer(*tables, args).collect()
    for r in found:
        print(f"{r['rank']:>3}  {r['node']:>6}  {r['label']}  {'' if r['value'] is None else round(r['value'], 3)}")
    print(f"{len(found)} found" if found else "none")


if __name__ == "__main__":
    main()
