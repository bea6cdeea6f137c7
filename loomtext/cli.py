"""Command line over the DataFrame API: texts in, annotation records out."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import backends
from loomtext.operators import annotate as A
from loomtext.operators import dialogue, graph
from loomtext.operators.segments import split_into_segments
from loomtext.sources import files, resources, writers


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    p.add_argument("-i", "--input", nargs="+", default=[], help="files, folders or globs")
    p.add_argument("--segments-json", help="a JSON array of texts or of objects with text")
    p.add_argument("--glob", default="*.txt")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("-o", "--output", default="-", help="a folder, or - for JSON lines on standard output")
    p.add_argument("--output-format", choices=files.FORMATS, default="json")
    p.add_argument("--single", action="store_true", help="write one part")
    p.add_argument("--include-text", action="store_true")
    p.add_argument("--verbs", action="store_true", help="verb frames; needs --spacy-model")
    p.add_argument("--spacy-model", help="a parser for names and verb frames")
    p.add_argument("--rule-names", action="store_true", help="names by rules where there is no parser")
    p.add_argument("--resources-dir", help="a folder of term lists")
    p.add_argument("--no-entity-ruler", action="store_true", help="match no phrases of the term lists")
    p.add_argument("--segments", type=int, default=100)
    p.add_argument("--no-chunk", action="store_true")
    p.add_argument("--testimony", "--qa-segmentation", action="store_true", dest="testimony")
    p.add_argument("--sentiment", choices=["off", "rule", "llm", "hf"], default="off")
    p.add_argument("--emotion", choices=["off", "rule", "llm", "hf"], default="off")
    p.add_argument("--emotion-dist", action="store_true")
    p.add_argument("--model", help="the model of --sentiment or --emotion hf or llm")
    p.add_argument("--provider", help="of language models; LLM_PROVIDER, LLM_MODEL and LLM_BASE_URL stand in for what isn't given")
    p.add_argument("--tqdm", action="store_true", help="show the progress of stages")
    p.add_argument("--base-url")
    p.add_argument("--interpret", action="store_true")
    p.add_argument("--viz", choices=["none", "map", "cooc"], default="none")
    p.add_argument("--viz-out")
    p.add_argument("--places", help="a CSV table with name, lat and lon, for --viz map")
    p.add_argument("--cooc-nodes", default="PERSON,GPE,CITY,COUNTRY,US-STATE,PLACE")
    p.add_argument("--window", type=int, default=1)
    p.add_argument("--info", action="store_true", help="count the terms of each list and end")
    return p.parse_args(argv)


def records(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The annotation records that the arguments ask for."""
    if args.segments_json:
        rows = files.read_segments_json(spark, args.segments_json)
    else:
        texts = files.read_texts(spark, args.input, args.glob, not args.no_recursive)
        if args.testimony:
            said = dialogue.testimony_records(texts, key="file")
            rows = said.join(texts.select("file", "fileId"), "file")
        elif args.no_chunk:
            rows = texts.withColumns({"segId": F.lit(1), "segCount": F.lit(1)})
        else:
            rows = split_into_segments(texts, args.segments)
    named = args.spacy_model or os.environ.get("SPACY_MODEL")
    model = backends.spacy_backend(named) if named else backends.rule_backend() if args.rule_names else None
    terms = {} if args.no_entity_ruler else resources.phrase_terms(args.resources_dir)
    out = A.annotate(rows, include_verbs=args.verbs, backend=model, folder=args.resources_dir, terms=terms)

    def made(kinds, name: str):
        if name == "llm":
            return backends.backend(kinds, name, answer=backends.configured_client(args.provider, args.model, args.base_url))
        return backends.backend(kinds, name, **({"model": args.model} if name == "hf" else {}))

    if args.sentiment != "off":
        out = A.with_sentiment(out, made(backends.SENTIMENT_BACKENDS, args.sentiment))
    if args.emotion != "off":
        out = A.with_emotion(out, made(backends.EMOTION_BACKENDS, args.emotion), args.emotion_dist)
    if args.interpret:
        out = A.with_interpretation(out)
    return out


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("loomtext").config("spark.ui.showConsoleProgress", str(args.tqdm).lower()).getOrCreate()
    if args.info:
        print(json.dumps({r["label"]: r["terms"] for r in resources.label_counts(spark, args.resources_dir).collect()}, sort_keys=True))
        return 0
    if not args.input and not args.segments_json:
        print("No input given.", file=sys.stderr)
        return 1
    out = records(spark, args)
    if args.input and not args.segments_json and out.isEmpty():
        print("Nothing fits the inputs.", file=sys.stderr)
        return 1
    if args.viz == "map":
        places = spark.read.option("header", True).csv(args.places) if args.places else None
        found = graph.features(graph.located(graph.place_mentions(out), places))
        with open(args.viz_out or "map.html", "w", encoding="utf-8") as page:
            page.write(writers.map_page(found))
    elif args.viz == "cooc":
        key = "file" if "file" in out.columns else "fileId"
        nodes = graph.segment_nodes(out, [n.strip() for n in args.cooc_nodes.split(",") if n.strip()], (key, "segId"))
        sizes = out.groupBy(key).agg(F.min("segId").alias("low"), F.max("segId").alias("high"))
        edges = graph.ranked_edges(graph.cooccurrence(nodes, args.window, key, sizes=sizes))
        target = args.viz_out or "cooc.csv"
        writers.save(edges, target, "csv" if target.endswith(".csv") else "tsv", single=True, mode="overwrite")
    shown = out if args.include_text else out.drop("text")
    if args.output == "-":
        for row in writers.json_lines(shown).toLocalIterator():
            print(row["value"])
    else:
        writers.save(shown, args.output, args.output_format, args.single)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
