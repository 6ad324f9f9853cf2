"""Text pipelines as tables of words, sentences and mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .setjoin import set_classes, similar_sets


def word_table(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, word): blank-separated words in lower case, without signs at their ends; empty ones keep their place."""
    words = F.transform(F.split(F.lower(text), r"\s"), lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    return df.select(*keys, F.posexplode(words).alias("pos", "word"))


def mentions(words: DataFrame, aliases: DataFrame, keys: list[str], negations: list[str], reach: int = 2) -> DataFrame:
    """(keys, pos, code, polarity): alias words, NEGATIVE if a negation stands among the `reach` words before.

    The window runs inside one text; the alias table meets only words that it holds.
    """
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-reach, -1)
    near = words.withColumn("_neg", F.coalesce(F.bool_or(F.col("word").isin(negations)).over(w), F.lit(False)))
    return near.join(aliases, "word").select(*keys, "pos", "code", F.when(F.col("_neg"), "NEGATIVE").otherwise("POSITIVE").alias("polarity"))


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sentence_no, sentence): parts that end in . ! ? or a line end, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*keys, F.posexplode(parts).alias("sentence_no", "sentence"))


def holds_in_order(words: Column, phrase: Column) -> Column:
    """Whether an array of words holds another as consecutive elements."""
    n = F.size(phrase)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(words, i, n) == phrase)


def tiered_retrieval(queries: DataFrame, terms: DataFrame, query: str, term: str, concept: str, grams: Column, least: float) -> DataFrame:
    """(query, concept, tier): EXACT match, else a term inside the query by words, else the best shared-gram match.

    Every tier is an equi-join: on the text, on word sequences of bounded length, and on the rarest grams of either side.
    """
    exact = queries.join(terms.select(F.col(term).alias(query), F.col(concept).alias("_exact")), query, "left")
    words = F.split(F.col(query), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    phrase = queries.select(query, F.explode(F.array_distinct(spans)).alias(term)).join(terms, term).groupBy(query).agg(F.max_by(concept, F.struct(F.length(term), concept)).alias("_phrase"))
    q, t = queries.select(F.col(query).alias("_t")), terms.select(F.col(term).alias("_t"), F.col(concept).alias("_c"))
    near = similar_sets(q.select("_t", grams.alias("_g")), t.select("_t", grams.alias("_g")), "_t", "_g", round(100 * least))
    # Texts of equal grams are one set; each has all its texts and concepts back.
    asked = set_classes(q.select("_t", grams.alias("_g")), "_t", "_g").select(F.col("id").alias(query), F.col("rep").alias("a"))
    held = set_classes(t.select("_t", grams.alias("_g")), "_t", "_g").select(F.col("id").alias("_t"), F.col("rep").alias("b")).join(t, "_t").groupBy("b").agg(F.min("_c").alias("c"))
    scored = near.select("a", "b", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("s")).join(held, "b").groupBy("a").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("_gram"))
    gram = asked.join(scored, "a").select(query, "_gram")
    out = exact.join(phrase, query, "left").join(gram, query, "left")
    tier = F.when(F.col("_exact").isNotNull(), "EXACT").when(F.col("_phrase").isNotNull(), "PHRASE").when(F.col("_gram").isNotNull(), "NGRAM").otherwise("NONE")
    return out.select(query, F.coalesce("_exact", "_phrase", "_gram").alias(concept), tier.alias("tier"))


def consolidated(df: DataFrame, surface: str, label: str) -> DataFrame:
    """(group, label, n_labels, surface): texts equal but for blanks form a group; its commonest surface and label, ties by order."""
    group = F.regexp_replace(surface, r"\s+", "")
    n = df.groupBy(group.alias("group"), surface, label).agg(F.count("*").alias("_n"))
    by_surface = n.groupBy("group", surface).agg(F.sum("_n").alias("_n")).groupBy("group").agg(F.max("_n").alias("_top"), F.min(F.struct(-F.col("_n"), surface)).alias("_s"))
    by_label = n.groupBy("group", label).agg(F.sum("_n").alias("_n")).groupBy("group").agg(F.min(F.struct(-F.col("_n"), label)).alias("_l"), F.count("*").alias("n_labels"))
    return by_surface.join(by_label, "group").select("group", F.col(f"_l.{label}").alias(label), "n_labels", F.col(f"_s.{surface}").alias(surface))


def matching_ratio(pairs: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """pairs with the Ratcliff-Obershelp ratio of two text columns, by Arrow batches."""
    import difflib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(**{name: [difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x[a], x[b], strict=True)]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, {name} double")


def best_window(query: str, text: str) -> tuple[float, int, int]:
    """(ratio, start, length) of the window of text, of the query's length or one less or more, whose Ratcliff-Obershelp ratio with the query is highest.

    Ties go to the smaller start, then the shorter window.  A text that is no
    longer than the query is one window, and an empty query or text has ratio 0.
    Shared letters bound a window's ratio from above; they are kept up as the
    window moves, so only windows that may beat the best so far are compared.
    """
    import difflib
    from collections import Counter

    size = len(query)
    if not size or not text:
        return 0.0, 0, 0
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    matcher.set_seq2(query)  # the side whose index is kept

    def ratio(window: str) -> float:
        matcher.set_seq1(window)
        return matcher.ratio()

    if len(text) <= size:
        return ratio(text), 0, len(text)
    letters, bounds = Counter(query), []
    for length in {max(1, size - 1), size, min(len(text), size + 1)}:
        inside = Counter(text[:length])
        shared = sum((inside & letters).values())
        for start in range(len(text) - length + 1):
            if start:
                gone, come = text[start - 1], text[start + length - 1]
                shared -= inside[gone] <= letters[gone]
                inside[gone] -= 1
                inside[come] += 1
                shared += inside[come] <= letters[come]
            bounds.append((-2.0 * shared / (length + size), start, length))
    best = (-1.0, 0, 0)
    for bound, start, length in sorted(bounds):
        if -bound < best[0]:
            break
        found = (ratio(text[start : start + length]), -start, -length)
        best = max(best, found)
    return best[0], -best[1], -best[2]


def windowed_ratio(pairs: DataFrame, query: str, text: str) -> DataFrame:
    """pairs with `ratio`, `start` and `length` of the text's best window for the query; each distinct pair is scored once, and pairs with a null have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [best_window(q, t) for q, t in zip(x["_q"], x["_t"], strict=True)]
            yield x.assign(ratio=[f[0] for f in found], start=[f[1] for f in found], length=[f[2] for f in found])

    distinct = pairs.select(F.col(query).alias("_q"), F.col(text).alias("_t")).where("_q is not null and _t is not null").distinct()
    scored = distinct.mapInPandas(run, "_q string, _t string, ratio double, start int, length int")
    return pairs.join(scored, (F.col(query) == F.col("_q")) & (F.col(text) == F.col("_t")), "left").drop("_q", "_t")


def class_scores(train: DataFrame, rows: DataFrame, label: str, grams: Column, id_col: str) -> DataFrame:
    """(id, label, score): log likelihood of a row's grams under each class, add-one smoothed, rounded to 6 places.

    Linear in the grams.  Training rows are reduced to counts of (class, gram)
    first; a row meets the counts of its own grams, and each class once.
    """
    counts = train.select(label, F.explode(grams).alias("_g")).groupBy(label, "_g").agg(F.count("*").alias("_n"))
    size = counts.agg(F.count_distinct("_g").alias("_v"))
    base = counts.groupBy(label).agg(F.sum("_n").alias("_t")).crossJoin(F.broadcast(size)).select(label, F.ln(F.col("_t") + F.col("_v")).alias("_base"))  # one row
    hits = rows.select(id_col, F.explode(grams).alias("_g")).join(counts, "_g").groupBy(id_col, label).agg(F.sum(F.ln(F.col("_n") + 1)).alias("_s"))
    each = rows.select(id_col, F.size(grams).alias("_k")).crossJoin(base)  # the output has a row for each class
    return each.join(hits, [id_col, label], "left").select(id_col, label, F.round(F.coalesce("_s", F.lit(0.0)) - F.col("_k") * F.col("_base"), 6).alias("score"))


def best_class(scores: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, label, margin): the class of the highest score, ties by name, and its lead over the next; null where there is no other."""
    best = F.min_by(F.struct(label, "score"), F.struct(-F.col("score"), F.col(label)))
    b = scores.groupBy(id_col).agg(best.alias("_b"))
    rest = scores.join(b.select(id_col, F.col(f"_b.{label}").alias("_l")), id_col).where(F.col(label) != F.col("_l")).groupBy(id_col).agg(F.max("score").alias("_next"))
    return b.join(rest, id_col, "left").select(id_col, F.col(f"_b.{label}").alias(label), F.round(F.col("_b.score") - F.col("_next"), 6).alias("margin"))


def agreement_route(first: Column, second: Column, first_margin: Column, second_margin: Column, least: float) -> Column:
    """AUTO if two classifiers agree and the first is sure, CONFIRM if they agree, ASK if only the second is sure, else HOLD."""
    same = first == second
    return F.when(same & (first_margin >= least), "AUTO").when(same, "CONFIRM").when(second_margin >= least, "ASK").otherwise("HOLD")
