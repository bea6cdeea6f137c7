"""Turns, testimony segments and question-answer pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import roles
from loomtext.functions import text as T


def label_lines(docs: DataFrame, speakers: Mapping[str, Sequence[str]] = roles.SPEAKERS, key: str = "fileId") -> DataFrame:
    """(key, line, role, tag, text): the lines that say something, line from 0."""
    each = docs.select(key, F.posexplode(T.lines(F.col("text"))).alias("line", "said"))
    found = each.withColumn("found", roles.detected_role(F.col("said"), speakers))
    return found.select(key, "line", "found.role", "found.tag", "found.text").where("text <> ''")


def in_order(value: Column, *order: Column) -> Column:
    """Values of a group joined by a blank, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
    return F.array_join(F.transform(pairs, lambda x: x["value"]), " ")


def merged_turns(rows: DataFrame, key: str, order: str, same: Sequence[str], apart: Column | None = None) -> DataFrame:
    """(key, turn, ..., text): runs of rows with the same values; a row where ``apart`` holds opens its own run.

    One shuffle by key serves both the window and the sum over runs.
    """
    by = Window.partitionBy(key).orderBy(order)
    opens = F.lag(F.lit(1)).over(by).isNull()
    for c in same:
        opens = opens | (F.lag(c).over(by) != F.col(c))
    if apart is not None:
        opens = opens | apart
    run = rows.withColumn("__opens", opens.cast("int")).withColumn("turn", F.sum("__opens").over(by))
    return run.groupBy(key, "turn").agg(*[F.first(c).alias(c) for c in same], in_order(F.col("text"), F.col(order).alias("at")).alias("text"))


def _sentence_rows(turns: DataFrame, key: str, columns: Sequence[str], sentence_safe: bool) -> DataFrame:
    parts = T.sentences(F.col("text")) if sentence_safe else F.array("text")
    each = turns.select(key, *columns, "turn", F.posexplode(parts).alias("at", "text"))
    by = Window.partitionBy(key).orderBy("turn", "at")
    return each.withColumn("ord", F.row_number().over(by)).drop("turn", "at")


def segment_testimony(
    docs: DataFrame,
    speakers: Mapping[str, Sequence[str]] = roles.SPEAKERS,
    join_continuations: bool = True,
    sentence_safe: bool = True,
    key: str = "fileId",
) -> DataFrame:
    """(key, turn_id, role, text, is_question, is_answer, qa_pair_id): one row a sentence, turn_id from 1.

    Lines of one role in a row are a turn. The first sentence after a question
    that isn't the interviewer's is its answer; other sentences have no pair.
    """
    rows = label_lines(docs, speakers, key)
    turns = merged_turns(rows, key, "line", ["role"]) if join_continuations else rows.withColumnRenamed("line", "turn")
    said = _sentence_rows(turns, key, ["role"], sentence_safe)
    return paired_turns(said.withColumnRenamed("ord", "turn_id"), key, "turn_id")


def paired_turns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, role, text, is_question, is_answer, qa_pair_id) of turns that have a role and text."""
    by = Window.partitionBy(key).orderBy(order)
    other = (F.col("role") != "interviewer").cast("int")
    asked = turns.withColumn("is_question", (F.col("role") == "interviewer") & roles.is_question(F.col("text")))
    counted = asked.withColumn("pair", F.sum(F.col("is_question").cast("int")).over(by))
    in_pair = Window.partitionBy(key, "pair").orderBy(order)
    nth = counted.withColumn("nth", F.sum(other).over(in_pair))
    answer = (F.col("role") != "interviewer") & (F.col("pair") > 0) & (F.col("nth") == 1)
    return nth.withColumn("is_answer", answer).select(
        key,
        order,
        "role",
        "text",
        "is_question",
        "is_answer",
        F.when(F.col("is_question") | F.col("is_answer"), F.col("pair")).cast("int").alias("qa_pair_id"),
    )


def extract_qa_pairs(
    docs: DataFrame,
    interviewer_tags: Sequence[str] = roles.INTERVIEWER_TAGS,
    exclude_tags: Sequence[str] = ("CREW",),
    speakers: Mapping[str, Sequence[str]] = roles.SPEAKERS,
    merge_multiturn: bool = True,
    sentence_safe: bool = True,
    key: str = "fileId",
) -> DataFrame:
    """(key, pairId, q_speaker, q_text, a_speaker, a_text), pairId from 1.

    A question is what the interviewer says from the first question of a run on;
    the answer is what the next speaker says until another speaks, or with
    ``merge_multiturn`` off only the first sentence. A question that nobody
    answers is dropped.
    """
    rows = label_lines(docs, speakers, key).withColumn("tag", F.when(F.col("tag") == "", F.upper("role")).otherwise(F.col("tag")))
    rows = rows.where(~F.col("tag").isin(*exclude_tags)) if exclude_tags else rows
    if merge_multiturn:
        turns = merged_turns(rows, key, "line", ["role", "tag"], F.startswith("text", F.lit("(")))
    else:
        turns = rows.withColumnRenamed("line", "turn")
    said = _sentence_rows(turns, key, ["role", "tag"], sentence_safe)
    return pairs_of(said, interviewer_tags, merge_multiturn, key)


def pairs_of(said: DataFrame, interviewer_tags: Sequence[str], merge_multiturn: bool, key: str) -> DataFrame:
    """Pairs of (key, ord, role, tag, text) rows.

    Runs of one speaker are islands, with every interviewer as one speaker. In an
    interviewer's run the question starts at its first question sentence.
    """
    asks = (F.col("role") == "interviewer") | F.col("tag").isin(*interviewer_tags)
    by = Window.partitionBy(key).orderBy("ord")
    spoken = said.withColumn("asks", asks).withColumn("who", F.when(asks, F.lit("\x01")).otherwise(F.col("tag")))
    opens = F.coalesce(F.lag("who").over(by) != F.col("who"), F.lit(True)).cast("int")
    runs = spoken.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by))
    in_run = Window.partitionBy(key, "run").orderBy("ord")
    question = F.max((F.col("asks") & roles.is_question(F.col("text"))).cast("int")).over(in_run)
    kept = runs.withColumn("begun", question).where(~F.col("asks") | (F.col("begun") == 1))
    islands = kept.groupBy(key, "run").agg(
        F.first("asks").alias("asks"),
        F.first("who").alias("who"),
        in_order(F.col("text"), F.col("ord").alias("at")).alias("whole"),
        F.min_by("text", "ord").alias("first"),
    )
    next_run = Window.partitionBy(key).orderBy("run")
    answer = F.col("whole") if merge_multiturn else F.col("first")
    looked = (
        islands.withColumn("a_speaker", F.lead("who").over(next_run))
        .withColumn("a_text", F.lead(answer).over(next_run))
        .where(F.col("asks") & F.col("a_text").isNotNull())
    )
    return looked.select(
        key,
        F.row_number().over(next_run).alias("pairId"),
        F.lit("INTERVIEWER").alias("q_speaker"),
        F.col("whole").alias("q_text"),
        "a_speaker",
        "a_text",
    )


def testimony_records(docs: DataFrame, key: str = "fileId", **options) -> DataFrame:
    """Sentences of :func:`segment_testimony` under the names that annotation records have."""
    said = segment_testimony(docs, key=key, **options)
    count = F.count("*").over(Window.partitionBy(key))
    return said.select(
        key,
        F.col("turn_id").alias("segId"),
        count.cast("int").alias("segCount"),
        "text",
        "role",
        F.col("turn_id").alias("turnId"),
        F.col("is_question").alias("isQuestion"),
        F.col("is_answer").alias("isAnswer"),
        F.col("qa_pair_id").alias("qaPairId"),
    )
