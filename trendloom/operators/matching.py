"""Matching of products across sources: blocks by brand, cosine of character n-grams, agreement of volume and form."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised_brand, normalised_name, product_form, product_volume, row_kind, without_brand
from ..sources.store import computed_once, spread
from .cosine_join import joined_names, vectors

# The least score and the weights of the agreements.
MIN_SCORE, VOLUME_WEIGHT, FORM_WEIGHT = 0.45, 0.15, 0.30
#: Lengths of the n-grams of a word with a space on either side.
SHORTEST, LONGEST = 2, 4


def features(products: DataFrame, strip_brand: bool = False) -> DataFrame:
    """source, product_key, name, brand, brand_norm, norm, vol, form of rows whose norm has more than one sign.

    Each distinct (name, brand, volume) goes through the patterns once, in as many tasks as there are cores.
    """
    asked = ["name", "brand", "volume"]
    parsed = spread(products.select(*asked).distinct()).withColumns({"brand_norm": normalised_brand(F.col("brand")), "norm": normalised_name(F.col("name")), "vol": product_volume(F.col("volume"), F.col("name")), "form": product_form(F.col("name"))})
    if strip_brand:
        parsed = parsed.withColumn("norm", without_brand(F.col("norm"), F.col("brand_norm")))
    out = products.alias("r").join(computed_once(parsed).alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in asked])
    return out.select("source", "product_key", "r.name", "r.brand", "brand_norm", "norm", "vol", "form").where(F.char_length("norm") > 1)


def grams(names: DataFrame) -> DataFrame:
    """norm, gram, tf for each distinct norm of names (norm)."""
    padded = names.select("norm", F.explode(F.split("norm", " ")).alias("word")).where("word <> ''").select("norm", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    sizes = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.char_length("w"))))
    sized = padded.select("norm", "w", sizes.alias("n"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") - F.col("n") + 1), lambda k: F.substring(F.col("w"), k, F.col("n"))))
    return sized.select("norm", cut.alias("gram")).groupBy("norm", "gram").agg(F.count("*").alias("tf"))


def gram_idf(rows: DataFrame) -> DataFrame:
    """gram, df, idf over all rows: a norm that several rows have counts as often."""
    names = rows.groupBy("norm").agg(F.count("*").alias("rows"))
    counted = grams(names).join(names, "norm").groupBy("gram").agg(F.sum("rows").alias("df"))
    return counted.select("gram", "df", (F.log((1 + F.lit(rows.count())) / (1 + F.col("df"))) + 1).alias("idf"))


def gram_weights(rows: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """norm, gram, weight: tf-idf with length 1 for each norm."""
    raw = grams(rows.select("norm").distinct()).join(gram_idf(rows) if idf is None else idf, "gram").select("norm", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("norm").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "norm").select("norm", "gram", (F.col("w") / F.col("length")).alias("weight"))


def volume_agreement(a: Column, b: Column) -> Column:
    """1 for the same amount of the same unit, -1 for another amount, 0 for other units or where one is unknown."""
    known = a.isNotNull() & b.isNotNull() & (a["unit"] == b["unit"])
    return F.when(known & (F.abs(a["amount"] - b["amount"]) < 1e-6), 1.0).when(known, -1.0).otherwise(0.0)


def form_agreement(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(-1.0)


def block_pairs(rows: DataFrame) -> DataFrame:
    """Number of pairs across sources within each brand, without making them: all pairs less those within a source."""
    per_source = rows.where("brand_norm <> ''").groupBy("brand_norm", "source").agg(F.count("*").alias("n"))
    return per_source.groupBy("brand_norm").agg(F.sum("n").alias("n_rows"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_pairs"))


def scored_names(rows: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Distinct names (id, brand_norm, norm, vol, form), and pairs id_a <= id_b, name_score, volume_agreement, form_agreement, score that reach min_score.

    A name that several sources have pairs with itself too. Names are scored once, however many rows have them.
    """
    idf = computed_once(gram_idf(rows))
    branded = rows.where("brand_norm <> ''").groupBy("brand_norm", "norm", "vol", "form").agg(F.min("source").alias("low"), F.max("source").alias("high")).withColumn("only", F.when(F.col("low") == F.col("high"), F.col("low")))
    names = computed_once(branded.withColumn("id", F.monotonically_increasing_id()).select("id", "brand_norm", "norm", "vol", "form", "only"))
    pairs = joined_names(names, vectors(gram_weights(rows, idf), idf), volume_agreement, form_agreement, min_score, VOLUME_WEIGHT, FORM_WEIGHT)
    score = F.col("cosine") + F.lit(VOLUME_WEIGHT) * F.col("volume") + F.lit(FORM_WEIGHT) * F.col("form")
    scored = pairs.select("id_a", "id_b", F.col("cosine").alias("name_score"), F.col("volume").alias("volume_agreement"), F.col("form").alias("form_agreement"), score.alias("score"))
    return names.drop("only"), scored.where(F.col("score") >= min_score)


#: Rows of one name that are kept in one array.
MEMBERS = 1 << 8
SCORES = ["score", "name_score", "volume_agreement", "form_agreement"]


class Matches(NamedTuple):
    """The pairs of rows that match, without making them: names are far fewer than rows, and all rows of a name have the same partners.

    rows: row (a number), id (of the name), source, product_key, name, brand, form. pairs: id_a <= id_b and SCORES, rounded after the cut.
    Two rows pair if their names do and their sources differ; the sources' order orients them.
    """

    rows: DataFrame
    pairs: DataFrame


def matches(rows: DataFrame, min_score: float = MIN_SCORE) -> Matches:
    """A pair without a common n-gram has at most 0.15 + 0.30 in doubles, just below the lowest useful score, so that pairs come from scored names (see cosine_join)."""
    if min_score < MIN_SCORE:
        raise ValueError(f"pairs without a common n-gram would be missed below {MIN_SCORE}")
    rows = computed_once(rows)
    names, scored = scored_names(rows, min_score)
    known = rows.where("brand_norm <> ''").alias("r").join(names.alias("n"), [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("brand_norm", "norm", "vol", "form")])
    known = known.select(F.monotonically_increasing_id().alias("row"), "id", "source", "product_key", "name", F.col("r.brand_norm").alias("brand"), F.col("r.form").alias("form"))
    return Matches(computed_once(known), computed_once(scored.withColumns({c: F.round(c, 4) for c in ("score", "name_score")})))


def met(pairs: DataFrame, members: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs (id_a, id_b, ..) with source_a < source_b and <name>_a, <name>_b (columns: name to column) of all members (id, source, ..) of both ids.

    The members of an id travel in arrays of at most MEMBERS, so that only pairs of names are shuffled, and pairs of rows are made in place.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy("source", *columns.values()))
    part = F.floor((place - 1) / MEMBERS).alias("part")
    kept = F.struct("source", *[F.col(c).alias(n) for n, c in columns.items()])
    arrays = computed_once(members.select("id", part, kept.alias("m")).groupBy("id", "part").agg(F.collect_list("m").alias("m")))
    side = lambda s, m: arrays.select(F.col("id").alias(f"id_{s}"), F.col("m").alias(m))
    both = pairs.join(side("b", "ys"), "id_b").join(side("a", "xs"), "id_a")
    one = both.select(*pairs.columns, F.explode("xs").alias("x"), "ys")
    each = one.select(*pairs.columns, "x", F.explode("ys").alias("y")).where("x.source < y.source or (x.source > y.source and id_a <> id_b)")
    first = F.col("x.source") < F.col("y.source")
    ends = lambda n: [F.when(first, F.col(f"x.{n}")).otherwise(F.col(f"y.{n}")).alias(f"{n}_a"), F.when(first, F.col(f"y.{n}")).otherwise(F.col(f"x.{n}")).alias(f"{n}_b")]
    return each.select(*pairs.columns, *[c for n in ("source", *columns) for c in ends(n)])


def counted(found: Matches, columns: dict[str, Column] | None = None) -> DataFrame:
    """id_a, id_b, SCORES, source_a, source_b, <column>_a, <column>_b and n, the number of pairs of rows that these stand for."""
    columns = columns or {}
    members = found.rows.select("id", "source", *[c.alias(n) for n, c in columns.items()]).groupBy("id", "source", *columns).agg(F.count("*").alias("n"))
    return met(found.pairs, members, {c: c for c in (*columns, "n")}).withColumn("n", F.col("n_a") * F.col("n_b"))


def candidates(rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs of rows of one brand and two sources that reach min_score, with all parts of the score (see Matches)."""
    return all_pairs(matches(rows, min_score))


def all_pairs(found: Matches) -> DataFrame:
    brands = found.rows.groupBy("id").agg(F.first("brand").alias("brand")).withColumnRenamed("id", "id_a")
    pairs = met(found.pairs.join(brands, "id_a"), found.rows, {"key": "product_key", "name": "name", "form": "form"})
    return pairs.select(*SCORES, "form_a", "form_b", "brand", "source_a", "key_a", "name_a", "source_b", "key_b", "name_b")


def ranked(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "source_a", "key_a", "source_b", "key_b")


def source_pairs(found: Matches) -> DataFrame:
    return counted(found).groupBy("source_a", "source_b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source_a", "source_b")


def conflicts(found: Matches) -> DataFrame:
    """Rows that have several partners in one other source: partners are counted for each name and source, and given to the rows that have it."""
    sources = found.rows.groupBy("id", "source").agg(F.count("*").alias("n")).withColumn("name_id", F.col("id"))
    ends = met(found.pairs.select("id_a", "id_b"), sources, {"name_id": "name_id", "n": "n"})
    partners = ends.groupBy(F.col("name_id_a").alias("id"), F.col("source_a").alias("source"), "source_b").agg(F.sum("n_b").alias("n"))
    given = found.rows.select("id", "source", "product_key").join(partners, ["id", "source"])
    return given.groupBy(F.col("source").alias("source_a"), F.col("product_key").alias("key_a"), "source_b").agg(F.sum("n").alias("n")).where("n > 1")


def score_histogram(found: Matches, floors: tuple[float, ...] = (0.9, 0.8, 0.7, 0.6, 0.5, 0.45)) -> DataFrame:
    """floor, n: pairs at or above each floor, in one pass."""
    wide = counted(found).agg(*[F.coalesce(F.sum(F.when(F.col("score") >= f, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, f in enumerate(floors)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.col(f"n{k}").alias("n")) for k, f in enumerate(floors)])).alias("r")).select("r.*")


def diagnostics(rows: DataFrame) -> DataFrame:
    """source, n_rows, n_brands (the empty one counts), n_volumes, n_forms."""
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("brand_norm").alias("n_brands"), F.count("vol").alias("n_volumes"), F.count(F.when(F.col("form") != "", 1)).alias("n_forms"))


def score_band(score: Column, edges: tuple[float, ...] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)) -> Column:
    """Number of the band of a score; bands are closed on the right, the last is open above."""
    out = None
    for k, high in enumerate(edges[1:]):
        out = F.when(score <= high, k) if out is None else out.when(score <= high, k)
    return out.otherwise(len(edges) - 1)


#: Rows that are drawn for each one that is wanted, and at least.
DRAWN, FEWEST = 4, 64


def label_sample(found: Matches, size: int = 300) -> DataFrame:
    """An empty answer and the pair, the same number for each band of scores; which ones is decided by a hash of the keys.

    The hash of every pair is compared with a limit for its band, which leaves some more than are wanted, as the size of a band is known; only
    these are sorted. A band in which fewer are left than it must give is drawn again with a higher limit.
    """
    pairs = found.pairs.withColumn("band", score_band(F.col("score")))
    sizes = {r["band"]: r["n"] for r in counted(found._replace(pairs=pairs)).groupBy("band").agg(F.sum("n").alias("n")).collect()}
    each = max(1, size // max(1, len(sizes)))
    keys = met(pairs, found.rows, {"key": "product_key", "row": "row"})
    draw = F.md5(F.concat_ws("|", "source_a", "key_a", "source_b", "key_b"))
    drawn, times, missing = [], {b: max(DRAWN * each, FEWEST) for b in sizes}, dict(sizes)
    while missing:
        share = {b: min(1.0, times[b] / n) for b, n in missing.items()}
        limit = {b: f"{int(x * 2**52):013x}" if x < 1 else "g" for b, x in share.items()}
        highest = F.element_at(F.create_map(*[F.lit(v) for kv in limit.items() for v in kv]), F.col("band"))
        some = computed_once(keys.where(F.col("band").isin(list(missing))).withColumn("draw", draw).where(F.col("draw") < highest))
        got = {r["band"]: r["count"] for r in some.groupBy("band").count().collect()}
        whole = {b for b in missing if got.get(b, 0) >= min(each, sizes[b])}
        drawn.append(some.where(F.col("band").isin(list(whole))))
        missing = {b: n for b, n in missing.items() if b not in whole}
        times = {b: 16 * n for b, n in times.items()}
    if not drawn:
        drawn = [keys.withColumn("draw", draw).limit(0)]
    order = Window.partitionBy("band").orderBy("draw")
    picked = reduce(DataFrame.unionByName, drawn).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    side = lambda s, *more: found.rows.select(F.col("row").alias(f"row_{s}"), F.col("name").alias(f"name_{s}"), F.col("form").alias(f"form_{s}"), *more)
    named = picked.join(side("a", "brand"), "row_a").join(side("b"), "row_b")
    lead = ["name_a", "name_b", "score", "brand"]
    return named.select(F.lit("").alias("is_same_product"), *lead, *SCORES[1:], "form_a", "form_b", "source_a", "key_a", "source_b", "key_b")


def silver_positives(rows: DataFrame) -> DataFrame:
    """Pairs across sources with equal norm and brand, whose volumes agree or are both unknown."""
    a, b = (rows.where("brand_norm <> ''").select("brand_norm", "norm", F.col("source").alias(f"source_{s}"), F.col("product_key").alias(f"key_{s}"), F.col("vol").alias(f"vol_{s}")) for s in "ab")
    pairs = a.join(b, ["brand_norm", "norm"]).where("source_a < source_b")
    alike = (volume_agreement(F.col("vol_a"), F.col("vol_b")) == 1.0) | (F.col("vol_a").isNull() & F.col("vol_b").isNull())
    return pairs.where(alike).select("brand_norm", "norm", "source_a", "key_a", "source_b", "key_b")


PAIR = ["source_a", "key_a", "source_b", "key_b"]


def best_pairs(found: Matches, score: str, budget: int) -> DataFrame:
    """The ``budget`` pairs (PAIR) of the highest score, ties by their keys. The budget is the feature.

    Names below the score that the best pairs have, as counted, are left out. Of the others, the first ``budget`` (score, source_a, key_a), each of which has
    a pair, hold all that are asked for; only the pairs of these are made.
    """
    counts = counted(found).groupBy(score).agg(F.sum("n").alias("n"))
    above = counts.withColumn("above", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score))) - F.col("n")).where(F.col("above") < budget)
    least = above.agg(F.min(score)).first()[0]
    if least is None:
        return found.rows.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in PAIR))
    pairs = computed_once(found.pairs.where(F.col(score) >= least).select("id_a", "id_b", score))
    sources = found.rows.groupBy("id", "source").agg(F.count("*").alias("n")).withColumn("name_id", F.col("id"))
    first = met(pairs, sources, {"name_id": "name_id"}).select(score, F.col("name_id_a").alias("id"), F.col("source_a").alias("source")).distinct()
    rows = found.rows.select("id", "source", "product_key")
    begins = first.join(rows, ["id", "source"]).select(score, "source", "product_key").distinct()
    begins = computed_once(begins.orderBy(F.desc(score), "source", "product_key").limit(budget))
    both = pairs.unionByName(pairs.where("id_a <> id_b").withColumns({"id_a": F.col("id_b"), "id_b": F.col("id_a")}))
    starts = rows.join(F.broadcast(begins.withColumnRenamed(score, "reached")), ["source", "product_key"]).select(F.col("id").alias("id_a"), F.col("source").alias("source_a"), F.col("product_key").alias("key_a"), "reached")
    ends = rows.select(F.col("id").alias("id_b"), F.col("source").alias("source_b"), F.col("product_key").alias("key_b"))
    made = both.join(F.broadcast(starts), "id_a").where(F.col(score) == F.col("reached")).join(ends, "id_b").where("source_a < source_b")
    return made.orderBy(F.desc(score), *PAIR).limit(budget).select(*PAIR)


def budget_overlap(found: Matches, one: str, other: str, budget: int = 675) -> DataFrame:
    """One row: how many pairs are among the best ``budget`` of both scores."""
    return best_pairs(found, one, budget).join(best_pairs(found, other, budget), PAIR, "left_semi").agg(F.count("*").alias("overlap"))


def recovery(best: dict[str, DataFrame], silver: DataFrame) -> DataFrame:
    """scorer, n_pairs, n_silver, n_recovered, n_shared: how many certain pairs each scorer's best pairs hold, and how many of these all scorers have."""
    keys = ["source_a", "key_a", "source_b", "key_b"]
    marked = [df.select(*keys, F.lit(name).alias("scorer")) for name, df in best.items()]
    named = computed_once(reduce(DataFrame.unionByName, marked))
    certain = computed_once(silver.select(*keys).distinct())
    shared = named.groupBy(*keys).agg(F.countDistinct("scorer").alias("scorers"))
    rows = named.join(shared, keys).join(certain.withColumn("silver", F.lit(1)), keys, "left")
    counted = rows.groupBy("scorer").agg(F.count("*").alias("n_pairs"), F.count("silver").alias("n_recovered"), F.count(F.when(F.col("scorers") == len(best), 1)).alias("n_shared"))
    return counted.select("scorer", "n_pairs", F.lit(certain.count()).cast("long").alias("n_silver"), "n_recovered", "n_shared")


def hubs(edges: DataFrame) -> DataFrame:
    """source_a, key_a, n_edges and induced pairs of rows that several rows are linked to."""
    counted = edges.groupBy("source_a", "key_a").agg(F.countDistinct("source_b", "key_b").alias("n_edges")).where("n_edges >= 2")
    return counted.withColumn("induced_pairs", (F.col("n_edges") * (F.col("n_edges") - 1) / 2).cast("long"))


def hub_summary(edges: DataFrame) -> DataFrame:
    """One row: n_hubs, their n_edges, the n_counterparts that these end in, and the pairs that they would put together."""
    found = hubs(edges)
    ends = edges.join(found.select("source_a", "key_a"), ["source_a", "key_a"], "left_semi").agg(F.countDistinct("source_b", "key_b").alias("n_counterparts"))
    total = found.agg(F.count("*").alias("n_hubs"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("induced_pairs"), F.lit(0)).alias("induced_pairs"))
    one = F.lit(1).alias("one")
    return total.select("*", one).join(ends.select("*", one), "one").select("n_hubs", "n_edges", "n_counterparts", "induced_pairs")


def hub_summary_of(found: Matches) -> DataFrame:
    """hub_summary of all pairs of found, without making them.

    Keys (source, product_key) whose rows have the same names have the same partners: they are one cell, and cells are linked instead of keys. A key that several rows have counts once.
    """
    keys = found.rows.groupBy("source", "product_key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    cells = keys.groupBy("source", "ids", F.col("product_key").isNull()).agg(F.count("*").alias("n"), F.count("product_key").alias("keyed"))
    cells = computed_once(cells.select(F.monotonically_increasing_id().alias("cell"), "source", "ids", "n", "keyed"))
    links = met(found.pairs.select("id_a", "id_b"), cells.select("cell", "source", F.explode("ids").alias("id")), {"cell": "cell"}).select("cell_a", "cell_b").distinct()
    links = computed_once(links.join(cells.select(F.col("cell").alias("cell_b"), F.col("keyed").alias("n_b")), "cell_b"))
    edges = links.groupBy(F.col("cell_a").alias("cell")).agg(F.sum("n_b").alias("e")).where("e >= 2").join(cells.select("cell", "n", "keyed"), "cell")
    ends = links.join(edges.where("keyed > 0").select(F.col("cell").alias("cell_a")), "cell_a", "left_semi").select("cell_b", "n_b").distinct().agg(F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_counterparts"))
    total = edges.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("n_hubs", F.col("n")), ("n_edges", F.col("n") * F.col("e")), ("induced_pairs", F.expr("n * (e * (e - 1) div 2)")))])
    one = F.lit(1).alias("one")
    return total.select("*", one).join(ends.select("*", one), "one").select("n_hubs", "n_edges", "n_counterparts", "induced_pairs")


def pair_type(kind_a: Column, kind_b: Column) -> Column:
    listings = (kind_a == "listing").cast("int") + (kind_b == "listing").cast("int")
    return F.when(listings == 0, "sku x sku").when(listings == 1, "listing x sku").otherwise("listing x listing")


def array_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, or null for one without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
