"""Clause scope: what is said of each mention in a text, by an automaton folded over a sentence's words.

A text is cut into sentences, a sentence into words with their places.  The fold
carries the clause, the negations that stand open in it, and the last mention
with the cues that have followed it; a second fold from right to left hands the
status of a mention on to the bare mentions listed before it.  Rows are not
shuffled, and a row's state is as long as its longest sentence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare_word(w: Column) -> Column:
    """In lower case, without signs at its ends."""
    return F.btrim(F.lower(w), F.lit(",;:()\"'"))


#: Matches no word.
NEVER = "(?!)"


@dataclass(frozen=True)
class Lexicon:
    """Words of mentions by code, and patterns of the words of each cue.

    `before` negates the mentions that come later in its clause, and where none
    does, the last one before it; `after` negates the mention that it follows.
    `persists` is a verb of ending, which negated says that something goes on.
    `opens` starts a clause, `endings` closes it, and so does a comma, unless it
    stands in a list: after a bare mention, before another or what may join them.  `lists` joins mentions, `loosely` only
    where the later one is affirmed; `particles` may stand between them.
    """

    mentions: dict[str, tuple[str, ...]]
    before: str = NEVER
    after: str = NEVER
    hedges: str = NEVER
    conditions: str = NEVER
    partly: str = NEVER
    improved: str = NEVER
    persists: str = NEVER
    past: str = NEVER
    others: str = NEVER
    opens: str = NEVER
    endings: str = NEVER
    lists: str = NEVER
    loosely: str = NEVER
    particles: str = NEVER
    #: Codes that a past mention is about as well as a present one.
    history: tuple[str, ...] = ()
    #: Form of a word in which mentions are looked up.
    form: Callable[[Column], Column] = bare_word

    def code(self, w: Column) -> Column:
        out = F.lit(None).cast("string")
        for code, words in self.mentions.items():
            out = F.when(w.isin(*words), code).otherwise(out)
        return out

    def token(self, w: Column) -> Column:
        """(n, code, role, opens, closes, comma) of a word as it is written; most words are told by one pattern to be none of all these."""
        cues = [c for c in _CUES if getattr(self, c) != NEVER]
        any_cue = "|".join(f"(?:{getattr(self, c)})" for c in (*cues, "opens", "endings"))
        named = self.form(w).isin(*[x for words in self.mentions.values() for x in words])
        comma = F.substring(w, -1, 1).isin(",", ";", ":")

        def parts(word: Column, code: Column) -> Column:
            role = F.lit("other")
            for c in reversed(cues):
                role = F.when(word.rlike(getattr(self, c)), c).otherwise(role)
            role = F.when(word == "", "particles").when(code.isNotNull(), "mention").otherwise(role)
            ending = word.rlike(self.endings)
            return F.struct(F.length(w).alias("n"), code.alias("code"), role.alias("role"), word.rlike(self.opens).alias("opens"), (comma | ending).alias("closes"), (comma & ~ending).alias("comma"))

        no = F.lit(False)
        plain = F.struct(F.length(w).alias("n"), F.lit(None).cast("string").alias("code"), F.lit("other").alias("role"), no.alias("opens"), no.alias("closes"), no.alias("comma"))
        return let(bare_word(w), lambda word: F.when((word == "") | comma | named | word.rlike(any_cue), let(self.code(self.form(w)), lambda code: parts(word, code))).otherwise(plain))


#: Cues in the order in which a word takes them.
_CUES = ("persists", "before", "after", "partly", "hedges", "conditions", "improved", "past", "others", "loosely", "lists", "particles")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences_at(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sentence_no, start, sentence, question): parts that end in . ! ? or a line end, blank ones left out but counted; `start` is the place of the first character.

    Null texts have no sentences.
    """
    rows = once(df, "_parts", F.split(F.col(text), r"[.!?\n]"), *keys, F.col(text).alias("_text"))
    begun = F.aggregate("_parts", F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + 1))
    rows = rows.select(*keys, "_text", F.posexplode(F.arrays_zip(F.col("_parts").alias("sentence"), begun.alias("start"))).alias("sentence_no", "_s"))
    stop = F.substring(F.col("_text"), F.col("_s.start") + F.length("_s.sentence") + 1, F.lit(1))
    return rows.select(*keys, "sentence_no", "_s.start", "_s.sentence", (stop == "?").alias("question")).where(F.trim("sentence") != "")


#: Roles that may stand in a list of mentions.
_JOINS = ("mention", "particles", "lists", "loosely")
#: What the fold carries of a mention: `bare` while only particles and list words have followed it, `tail` the words of `before` that have.
_MENTION = "struct<at: int, code: string, clause: int, negations: int, tail: int, hedged: boolean, conditional: boolean, partly: boolean, improved: boolean, persists: boolean, bare: boolean, loose: boolean>"
#: `listed`: the last word closed a list item by a comma.
_SCOPE = f"struct<clause: int, before: int, hedged: boolean, conditional: boolean, listed: boolean, past: boolean, other: boolean, held: {_MENTION}, out: array<{_MENTION}>, bounds: array<struct<clause: int, start: int>>>"
_STATE = f"struct<at: int, scope: {_SCOPE}>"
_NONE = f"cast(null as {_MENTION})"


def _named(kind: str, *values: Column) -> Column:
    names = [x.split(":")[0].strip() for x in _fields(kind)]
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)]).cast(kind)


def _fields(kind: str) -> list[str]:
    """The fields of a struct type, by the commas of its own level."""
    out, depth = [""], 0
    for ch in kind[len("struct<") : -1]:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _left(held: Column) -> Column:
    """A mention whose clause is over: what negated nothing later negates it, and it shares no later status."""
    kept = [held[n] for n in ("at", "code", "clause")]
    return _named(_MENTION, *kept, held["negations"] + held["tail"], F.lit(0), *[held[n] for n in ("hedged", "conditional", "partly", "improved", "persists")], F.lit(False), held["loose"])


def _step(state: Column, t: Column) -> Column:
    """The state after a word; one that is no cue changes the place only, unless it ends a list."""
    acc = state["scope"]
    quiet = (t["role"] == "other") & ~t["opens"] & ~t["closes"] & ~acc["listed"] & ~F.coalesce(acc["held"]["bare"], F.lit(False))
    return F.struct((state["at"] + t["n"] + 1).alias("at"), F.when(quiet, acc).otherwise(_scope_after(state["at"], acc, t)).alias("scope"))


def _scope_after(at: Column, acc: Column, t: Column) -> Column:
    is_ = lambda *roles: t["role"].isin(*roles)
    no, none = F.lit(False), F.expr(_NONE)

    def clause_known(opens: Column) -> Column:
        held, keeps = acc["held"], ~opens
        clause = acc["clause"] + opens.cast("int")
        before, hedged, conditional = F.when(opens, 0).otherwise(acc["before"]), acc["hedged"] & keeps, acc["conditional"] & keeps
        new = _named(_MENTION, at, t["code"], clause, before, F.lit(0), hedged, conditional, no, no, no, F.lit(True), no)
        grown = _named(_MENTION, held["at"], held["code"], held["clause"], held["negations"] + is_("after").cast("int"), held["tail"] + is_("before").cast("int"), held["hedged"] | is_("hedges"), held["conditional"] | is_("conditions"), held["partly"] | is_("partly"), held["improved"] | is_("improved"), held["persists"] | is_("persists"), held["bare"] & is_(*_JOINS), held["loose"] | is_("loosely"))
        now = F.when(is_("mention"), new).when(held["at"].isNotNull() & keeps, grown).otherwise(none)

        def mention_known(now: Column) -> Column:
            listed = t["comma"] & F.coalesce(now["bare"], no)

            def end_known(ends: Column) -> Column:
                # The mention held before leaves when its clause is over or another comes; this word may end the clause of the one held now.
                has = held["at"].isNotNull()
                left = F.array_compact(F.array(F.when(opens & has, _left(held)).when(is_("mention") & has, held), F.when(ends & now["at"].isNotNull(), _left(now))))
                out = F.when(F.size(left) > 0, F.concat(acc["out"], left)).otherwise(acc["out"])
                starts = F.array_compact(F.array(F.when(opens, F.struct(clause.alias("clause"), at.alias("start"))), F.when(ends, F.struct((clause + 1).alias("clause"), (at + t["n"] + 1).alias("start")))))
                bounds = F.when(F.size(starts) > 0, F.concat(acc["bounds"], starts)).otherwise(acc["bounds"])
                goes_on = ~ends
                return _named(_SCOPE, clause + ends.cast("int"), F.when(ends, 0).otherwise(before + is_("before").cast("int")), (hedged | is_("hedges")) & goes_on, (conditional | is_("conditions")) & goes_on, listed, acc["past"] | is_("past"), acc["other"] | is_("others"), F.when(ends, none).otherwise(now), out, bounds)

            return let(t["closes"] & ~listed, end_known)

        return let(now, mention_known)

    return let(t["opens"] | (acc["listed"] & ~is_(*_JOINS)), clause_known)


def once(rows: DataFrame, name: str, value: Column, *columns: str) -> DataFrame:
    """columns and a value that is worked out once a row, however many columns are taken from it later: a generator is not copied into them."""
    return rows.select(*columns, F.explode(F.array(value)).alias(name))


def _scanned(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """(keys, sentence_no, start, sentence, question, _done, _mentions): sentences with the end state of the fold and their mentions."""
    rows = sentences_at(df, keys, text)
    no = F.lit(False)
    begin = _named(_SCOPE, F.lit(0), F.lit(0), no, no, no, no, no, F.expr(_NONE), F.array().cast(f"array<{_MENTION}>"), F.array(F.struct(F.lit(0).alias("clause"), F.lit(0).alias("start"))))
    begin = F.struct(F.lit(0).alias("at"), begin.alias("scope"))
    done = F.aggregate(F.transform(F.split("sentence", r"\s"), lexicon.token), begin, _step)["scope"]
    rows = once(rows, "_done", done, *keys, "sentence_no", "start", "sentence", "question")
    last = F.col("_done.held")
    return rows.withColumn("_mentions", F.when(last["at"].isNotNull(), F.array_append("_done.out", _left(last))).otherwise(F.col("_done.out")))


def clauses(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """(keys, sentence_no, clause, start, end, words): the clauses of each sentence, by places in the text; those without a word are left out."""
    rows = _scanned(df, keys, text, lexicon).select(*keys, "sentence_no", "start", "sentence", F.col("_done.bounds").alias("_bounds"))
    nexts = F.concat(F.slice("_bounds.start", F.lit(2), F.greatest(F.size("_bounds") - 1, F.lit(0))), F.array(F.length("sentence") + 1))
    each = rows.withColumn("_b", F.explode(F.zip_with("_bounds", nexts, lambda b, n: F.struct(b["clause"].alias("clause"), b["start"].alias("from"), (n - 1).alias("to")))))
    words = F.trim(F.substring(F.col("sentence"), F.col("_b.from") + 1, F.col("_b.to") - F.col("_b.from")))
    return each.select(*keys, "sentence_no", F.col("_b.clause").alias("clause"), (F.col("start") + F.col("_b.from")).alias("start"), (F.col("start") + F.col("_b.to")).alias("end"), words.alias("words")).where("words <> ''")


def _own_status(m: Column, has_next: Column) -> Column:
    """What a mention's own zone says; INHERIT and INHERIT_POSITIVE leave it to the next mention."""
    bare = m["bare"] & (m["negations"] == 0) & has_next
    by_count = F.when(m["negations"] == 0, "POSITIVE").when((m["negations"] == 1) & ~m["partly"], "NEGATIVE").otherwise("UNCERTAIN")
    return F.when(m["hedged"] | m["conditional"], "UNCERTAIN").when(m["persists"] & (m["negations"] > 0), "POSITIVE").when(m["improved"], "UNCERTAIN").when(bare & m["loose"], "INHERIT_POSITIVE").when(bare, "INHERIT").otherwise(by_count)


def mention_contexts(df: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """(keys, sentence_no, clause, at, code, status, negations, past, other, question) of every mention; `at` is its place in the text.

    `status`: POSITIVE, NEGATIVE, UNCERTAIN (hedged, conditional, improved, partly
    or doubly negated) or UNKNOWN (listed before a mention that it may not share
    the status of).  Negation and hedges do not cross a clause; a question, a past
    word and another person hold for the whole sentence.  Null and blank texts have
    no mentions.  Keys may repeat; other columns are ignored.
    """
    rows = _scanned(df, keys, text, lexicon)
    begin = F.struct(F.lit(None).cast("string").alias("next"), F.array().cast("array<string>").alias("out"))

    def judge(acc: Column, m: Column) -> Column:
        own = _own_status(m, acc["next"].isNotNull())
        status = F.when(own == "INHERIT", acc["next"]).when(own == "INHERIT_POSITIVE", F.when(acc["next"] == "POSITIVE", "POSITIVE").otherwise("UNKNOWN")).otherwise(own)
        return F.struct(status.alias("next"), F.array_append(acc["out"], status).alias("out"))

    status = F.reverse(F.aggregate(F.reverse("_mentions"), begin, judge)["out"])
    each = F.zip_with("_mentions", status, lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    rows = rows.where(F.size("_mentions") > 0).select(*keys, "sentence_no", "start", F.col("_done.past").alias("_past"), F.col("_done.other").alias("other"), "question", F.explode(each).alias("_x"))
    m = F.col("_x.m")
    past = F.col("_past") & ~m["code"].isin(*lexicon.history) if lexicon.history else F.col("_past")
    return rows.select(*keys, "sentence_no", m["clause"].alias("clause"), (F.col("start") + m["at"]).alias("at"), m["code"].alias("code"), F.col("_x.s").alias("status"), m["negations"].alias("negations"), past.alias("past"), "other", "question")


def evidence(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, status): what a text says for certain of the present and of its own person; codes of which it says both are left out."""
    sure = contexts.where(F.col("status").isin("POSITIVE", "NEGATIVE") & ~F.col("past") & ~F.col("other") & ~F.col("question"))
    return sure.groupBy(*keys, "code").agg(F.min("status").alias("status"), F.max("status").alias("_other")).where("status = _other").drop("_other")
