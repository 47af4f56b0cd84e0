"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must contain:
a conjunction of clauses, each a choice between sets of trigrams. The index holds a posting (trigram, document)
for every mandatory trigram of any rule that the lower-cased text contains, laid out by trigram. The postings are intersected by document and the queries evaluated; the surviving candidates alone are
verified by the regular expressions. Rules without mandatory trigrams scan all texts in place.
The rules are few and fixed, so that the index has a bounded number of postings for each document.

Defined results: a null text counts as empty and has no spans; texts of any length are scanned whole; rows with the same id
and text share one entry of the index, and each is verified and gets the same result; rows with a null id are kept
apart by their texts; an empty table gives an empty table. Columns other than doc_id and text are not looked at and may
have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, whole_row


@dataclass(frozen=True)
class Rule:
    """kind, a regular expression, the group whose length counts, and its least length; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds. The order is that of kinds within a start (fixed values).
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
BASE = ("assign", "access", "hex")
#: Strings that a part of a pattern may stand for before it counts as unknown.
MOST = 64

Query = list[list[frozenset[str]]]  # all of: any of: all of these trigrams


def _strings(items) -> tuple[set[str] | None, Query]:
    """What a parsed pattern matches exactly, if that is few strings, and the query that holds for any match."""
    query: Query = []
    now: set[str] = {""}
    whole = True

    def flush() -> None:
        nonlocal now, whole
        query.extend(_clause(now))
        now, whole = {""}, False

    for op, arg in items:
        name = str(op)
        exact: set[str] | None = None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            signs = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            exact = signs if len(signs) <= 8 else None
        elif name == "SUBPATTERN":
            exact, inner = _strings(arg[-1])
            query.extend(inner if exact is None else [])
        elif name == "BRANCH":
            branches = [_strings(b) for b in arg[1]]
            if all(b[0] is not None for b in branches):
                exact = set().union(*(b[0] for b in branches))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            found, _ = _strings(inner)
            if found is not None and (low, high) == (0, 1):
                exact = found | {""}
            elif found is not None and low == high == 1:
                exact = found
        product = {a + b for a in now for b in exact} if exact is not None and len(now) * len(exact) <= MOST else None
        if product is None:
            flush()
        else:
            now = product
    if not whole:
        query.extend(_clause(now))
        return None, query
    return now, query


def _clause(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return []
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return [sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)]


def trigram_query(pattern: str) -> Query:
    """The query of a pattern over lower-cased text; empty if no trigram is mandatory."""
    exact, query = _strings(parser.parse(pattern))
    return query + (_clause(exact) if exact is not None else [])


def key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram (its number), _id, _text (a hash): the inverted index over the given trigrams, laid out by trigram.

    A substring search for each trigram takes less time than one pass of an alternation of them all."""
    low = docs.select(*key(), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    found = low.select(F.explode(held).alias("trigram"), "_id", "_text")
    return found.repartition("trigram", F.pmod("_text", F.lit(64))).sortWithinPartitions("trigram")


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """_id, _text and a Boolean column for each rule with a query; documents that no query accepts are left out."""
    blocks = range(0, len(trigrams), 62)
    bits = [F.expr(f"bit_or(if(trigram between {b} and {b + 61}, shiftleft(1L, trigram - {b}), 0L))").alias(f"bits{b}") for b in blocks]
    met = index.groupBy("_id", "_text").agg(*bits)
    number = {t: k for k, t in enumerate(trigrams)}

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            any_of = F.lit(False)
            for grams in clause:
                all_of = F.lit(True)
                for b in blocks:
                    mask = sum(1 << (number[g] - b) for g in grams if b <= number[g] < b + 62)
                    if mask:
                        all_of = all_of & (F.col(f"bits{b}").bitwiseAND(F.lit(mask)) == mask)
                any_of = any_of | all_of
            out = out & any_of
        return out

    found = met.select("_id", "_text", *[holds(q).alias(k) for k, q in queries.items()])
    return found.where(" or ".join(queries))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end, kind) of the matches, leftmost and not overlapping, in code points.

    Each part ends with a match and begins where the part before ended, so that lengths give positions.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{rule.pattern})"), F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        match = F.regexp_extract(part, rule.pattern, 0)
        own = F.regexp_extract(part, rule.pattern, rule.group) if rule.group else match
        span = F.array(F.struct((end - F.char_length(match)).alias("start"), F.lit(number).alias("k"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(F.char_length(own) >= rule.least, span).otherwise(F.expr(EMPTY))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("out")), step, lambda acc: acc["out"])


EMPTY = "cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)"


def with_spans(docs: DataFrame, scratch: Scratch, rules: list[Rule]) -> DataFrame:
    """_id, row (all columns of docs), text (null counts as empty) and spans (array, sorted) for each row of docs."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({g for q in queries.values() for clause in q for grams in clause for g in grams})
    index = scratch.save(postings(docs, trigrams))
    chosen = maybe_broadcast(scratch.kept(candidates(index, queries, trigrams))).withColumnsRenamed({"_id": "_cid", "_text": "_ctext"})
    keyed = docs.select(*key(), whole_row(docs))
    joined = keyed.join(chosen, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_text") == F.col("_ctext")), "left").withColumn("text", F.coalesce("row.text", F.lit("")))
    each = []
    for k, r in enumerate(rules):
        # candidates only; rules without a query look at every text, where it is
        here = F.col(r.kind) if r.kind in queries else F.col("text").rlike(f"{r.pattern[:-1]}{{{r.least},}}" if r.pattern.endswith("]+") else r.pattern)
        each.append(F.when(here, spans(F.col("text"), r, k)).otherwise(F.expr(EMPTY)))
    return joined.select("_id", "row", "text", F.array_sort(F.concat(*each)).alias("spans"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        found = with_spans(docs.select("doc_id", "text"), scratch, rules)
        base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
        count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
        return found.select(F.col("_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span of a secret replaced by a mark; all rows stay, and n_chars follows the text if there is one."""
    with Scratch(docs.sparkSession) as scratch:
        found = with_spans(docs, scratch, rules)

        def step(acc: Column, s: Column) -> Column:
            new = s["start"] >= acc["at"]
            before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

        clean = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
        some = F.size("spans") > 0
        new = {"text": F.when(some, clean).otherwise(F.col("row.text"))}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(some, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _oracle_kind(number: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
            SELECT doc_id, regexp_extract(part, '{p}') AS m, regexp_extract(part, '{p}', {rule.group}) AS g,
                   sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
                  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:{p})') AS parts FROM documents)))
        WHERE length(g) >= {rule.least}"""


ORACLE_SQL = f"""
    WITH f AS ({" UNION ALL ".join(_oracle_kind(k, r) for k, r in enumerate(RULES))}),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
                 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
                 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN g USING (doc_id)"""
