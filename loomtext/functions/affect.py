"""Rule-based sentiment and emotion, and the shapes that model backends share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import count_in, let, tokens_among

POSITIVE = frozenset(
    "free freedom happiness happy help helped hope joy kind kindness love peace protected relief"
    " reunited safe safely support welcome welcomed".split()
)
NEGATIVE = frozenset(
    "afraid alone anger angry beaten cold cried cry danger dead death disgust fear hate hated hunger hurt ill"
    " killed lonely loss lost pain sad sadness sick starvation starved terror threat unsafe".split()
)
EMOTIONS = ("neutral", "joy", "surprise", "sadness", "fear", "anger", "disgust")
EMOTION_WORDS: dict[str, frozenset[str]] = {
    "joy": frozenset("comfort grateful happiness happy joy love relief".split()),
    "surprise": frozenset("astonished suddenly surprised unexpected".split()),
    "sadness": frozenset("cried cry grief mourning sad sadness tears".split()),
    "fear": frozenset("afraid fear panic scared terrified threat".split()),
    "anger": frozenset("anger angry enraged furious rage resentment".split()),
    "disgust": frozenset("disgust disgusted nausea nauseated revolted".split()),
}
VALENCE = {"joy": 1.0, "surprise": 0.2, "sadness": -1.0, "fear": -0.8, "anger": -0.7, "disgust": -0.7, "neutral": 0.0}
_SYNONYMS = {"happiness": "joy", "sad": "sadness"}

SENTIMENT = "struct<label:string,score:double,signed:double>"
EMOTION = "struct<label:string,score:double,signed:double,distribution:map<string,double>>"


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """The value held between the limits; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def polarity_counts(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(pos, neg): tokens of either list, each time they occur; zeros for null."""
    return let(tokens_among(text, [*positive, *negative]), lambda w: F.struct(count_in(w, positive).alias("pos"), count_in(w, negative).alias("neg")))


def sentiment_of_counts(pos: Column, neg: Column) -> Column:
    """(label, score, signed) with score = tanh of a third of the difference."""
    score = F.tanh((pos - neg) / F.lit(3.0))
    label = F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), score.alias("score"), score.alias("signed"))


def rule_sentiment(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    return let(polarity_counts(text, positive, negative), lambda n: sentiment_of_counts(n["pos"], n["neg"]))


def normal_label(label: Column) -> Column:
    """positive, negative or neutral, from any spelling that starts as the first two."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low.startswith("pos"), "positive").when(low.startswith("neg"), "negative").otherwise("neutral")


def signed_from_scores(scores: Column, normalize: bool = True) -> Column:
    """Signed score of a map of label to probability: (p - n) over p + n, or p - n.

    Names of labels count as those of three-way models do: ``label_0`` is
    negative, ``label_1`` neutral and ``label_2`` positive.
    """
    either = lambda *names: F.coalesce(*[scores[n] for n in names], F.lit(0.0))
    p, n = either("positive", "pos", "label_2"), either("negative", "neg", "label_0")
    return clamp((p - n) / F.greatest(p + n, F.lit(1e-9)) if normalize else p - n)


def signed_from_top(label: Column, score: Column) -> Column:
    name = normal_label(label)
    return F.when(name == "positive", score).when(name == "negative", -score).otherwise(F.lit(0.0))


def emotion_counts(text: Column, words: Mapping[str, Sequence[str]] = EMOTION_WORDS) -> Column:
    """Tokens of each emotion in the order of ``EMOTIONS``; neutral has none."""
    return let(tokens_among(text, [x for e in EMOTIONS for x in words.get(e, ())]), lambda w: F.array(*[count_in(w, words[e]) if words.get(e) else F.lit(0) for e in EMOTIONS]))


def emotion_of_counts(counts: Column) -> Column:
    """(label, score, signed, distribution): softmax over all seven labels.

    Without a hit the text is neutral with certainty. Ties go to the label that
    is first in ``EMOTIONS``.
    """

    def shares(n: Column) -> Column:
        whole = F.aggregate(n, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double")))
        return let(whole, lambda z: F.transform(n, lambda x: F.exp(x.cast("double")) / z))

    def read(p: Column) -> Column:
        names = F.array(*map(F.lit, EMOTIONS))
        top = F.array_max(p)
        signed = clamp(sum((F.get(p, F.lit(i)) * VALENCE[e] for i, e in enumerate(EMOTIONS) if i), F.lit(0.0)))
        return F.struct(
            F.get(names, (F.array_position(p, top) - 1).cast("int")).alias("label"),
            top.alias("score"),
            signed.alias("signed"),
            F.map_from_arrays(names, p).alias("distribution"),
        )

    # without a hit the answer is a constant
    certain = read(F.array(*[F.lit(1.0 if e == "neutral" else 0.0) for e in EMOTIONS]))
    return let(counts, lambda n: F.when(F.exists(n, lambda x: x > 0), let(shares(n), read)).otherwise(certain))


def rule_emotion(text: Column, words: Mapping[str, Sequence[str]] = EMOTION_WORDS) -> Column:
    return emotion_of_counts(emotion_counts(text, words))


def normal_emotion(label: Column) -> Column:
    """Lower case, with synonyms folded; other names pass through."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(*[F.when(low == k, v) for k, v in _SYNONYMS.items()], low)


def emotion_signed_from_top(label: Column, score: Column) -> Column:
    """Valence of the label times its score; 0 for a label without valence."""
    name = normal_emotion(label)
    weight = F.coalesce(*[F.when(name == k, v) for k, v in VALENCE.items()], F.lit(0.0))
    return clamp(weight * score)


def emotion_signed_from_distribution(distribution: Column) -> Column:
    return clamp(sum((F.coalesce(distribution[k], F.lit(0.0)) * v for k, v in VALENCE.items()), F.lit(0.0)))


def renormalized(distribution: Column, labels: Sequence[str] = EMOTIONS) -> Column:
    """The seven labels' shares of their sum; as they are where the sum is 0."""

    def shares(value: Column) -> Column:
        whole = sum((F.get(value, F.lit(i)) for i in range(1, len(labels))), F.get(value, F.lit(0)))
        return let(F.when(whole == 0, 1.0).otherwise(whole), lambda z: F.map_from_arrays(F.array(*map(F.lit, labels)), F.transform(value, lambda v: v / z)))

    def read(known: Column) -> Column:
        return F.when(known.isNotNull(), let(F.array(*[F.coalesce(known[k], F.lit(0.0)) for k in labels]), shares))

    return let(distribution, read)
