"""Join of names by cosine, where the least cosine of a pair depends on what else the two agree in: a weighted prefix filter.

A name is a vector of length 1 over n-grams, in one order for all names: the rarest first. ``reach`` of a gram is the length of
what the vector has from this gram on. Take the first gram that two names share: both have all that they share from there
on, so that their cosine is not more than either reach. A pair is therefore found by a gram whose reach is at least its least
cosine on both sides, and the frequent grams at the end of the vectors bring no pairs together.

The least cosine of a pair is what the least score leaves after the agreements of volume and form. Pairs that agree in form, in volume or in
both have low ones, but share these as keys; those that agree in neither share only brand and gram, and only their rarer grams are
entered there. A crowded key is split into blocks of two slices of its names at most.

The cosine belongs to the words alone, so that words are entered once under a key, however many volumes and forms they come with, and
each two of them are multiplied once for each brand. Names are put back for those that are close enough: by an equal volume
where the cosine needs one, else each with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import computed_once, spread
from .blocks import SLICE, pairs_within

#: Sums in another order may differ by this much.
SLACK = 1e-9


def vectors(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """norm, grams: array of (gram, weight, reach), the rarest first, and weight_of: a map of the same weights, from weights (norm, gram, weight) and idf (gram, df, idf)."""
    rare = weights.join(idf.select("gram", "df"), "gram").groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "weight"))).alias("g"))
    tail = lambda k: F.sqrt(F.aggregate(F.slice(F.col("g"), k, F.size("g")), F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    reached = F.transform("g", lambda x, k: F.struct(x["gram"].alias("gram"), x["weight"].alias("weight"), tail(k + 1).alias("reach")))
    return rare.select("norm", reached.alias("grams"), F.map_from_arrays("g.gram", "g.weight").alias("weight_of"))


def cosine(a: Column, b: Column) -> Column:
    """Of two maps from grams to weights: the sum of products over the grams that both have."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0))))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def least_cosine(volume: Column, form: Column, min_score: float, volume_weight: float, form_weight: float) -> Column:
    return F.lit(min_score) - F.lit(volume_weight) * volume - F.lit(form_weight) * form


def _least(kind: int, min_score: float, volume_weight: float, form_weight: float) -> Column:
    """The least cosine under a kind. 3: volume and form agree, 2: the form alone, 1: the volume alone, 0: neither."""
    return least_cosine(F.lit(float(kind in (1, 3))), F.lit(float(kind in (2, 3))), min_score, volume_weight, form_weight)


def _millionths(amount: Column) -> Column:
    """An amount in millionths; those beyond a long's range share one number."""
    return F.least(F.round(amount * 1e6), F.lit(9e18)).cast("long")


def _entries(names: DataFrame, norms: DataFrame, min_score: float, volume_weight: float, form_weight: float) -> DataFrame:
    """key, id, block, kind: under which keys the grams of a norm (its number is the id) are entered, once for all names that have it.

    A volume is known by its amount in millionths. Finer amounts are entered under the next ones too, so that amounts less than a millionth apart always meet.
    """
    micros = _millionths(F.col("vol.amount"))
    fine = F.abs(F.round("vol.amount", 5) - F.col("vol.amount")) > 0
    amounts = F.when(F.col("vol").isNull(), F.array().cast("array<long>")).when(fine, F.array(micros - 1, micros, micros + 1)).otherwise(F.array(micros))
    tags = F.transform(amounts, lambda m: F.concat_ws(":", F.col("vol.unit"), m.cast("string")))
    formed = F.col("form") != ""
    kind = lambda k, tag, form: F.named_struct(F.lit("kind"), F.lit(k), F.lit("tag"), tag, F.lit("form"), form)
    none = F.lit("")
    kinds = F.concat(
        F.transform(tags, lambda t: kind(3, t, F.col("form"))), F.array(kind(2, none, F.col("form"))), F.transform(tags, lambda t: kind(1, t, none)), F.array(kind(0, none, none))
    )
    usable = F.filter(kinds, lambda k: formed | ~k["kind"].isin(2, 3))
    least = [_least(k, min_score, volume_weight, form_weight) for k in range(4)]
    floor = F.when(F.col("k.kind") == 3, least[3]).when(F.col("k.kind") == 2, least[2]).when(F.col("k.kind") == 1, least[1]).otherwise(least[0])
    named = names.select("n", "block", F.explode(usable).alias("k")).distinct().join(norms.select("n", "grams"), "n").withColumn("floor", floor - SLACK)
    flat = named.select("n", "block", "k", F.explode(F.filter("grams", lambda g: g["reach"] >= F.col("floor"))).alias("g"))
    # one number for each key: should two keys share one, more pairs are met, which the brand and the score then sort out
    key = F.xxhash64("block", "g.gram", "k.kind", "k.tag", "k.form").alias("key")
    return flat.select(key, F.col("n").alias("id"), "block", F.col("k.kind").cast("byte").alias("kind"))


def close_norms(names: DataFrame, norms: DataFrame, min_score: float, volume_weight: float, form_weight: float, slice_size: int = SLICE) -> DataFrame:
    """block, n_a <= n_b, cosine, kinds (bits): numbers of norms of one block (a brand), close enough for at least one of the kinds under which they met."""
    met = pairs_within(_entries(names, norms, min_score, volume_weight, form_weight), "key", slice_size).where("kind_a = kind_b and block_a = block_b")
    bit = F.when(F.col("kind_a") == 3, 8).when(F.col("kind_a") == 2, 4).when(F.col("kind_a") == 1, 2).otherwise(1)
    met = met.groupBy(F.col("block_a").alias("block"), F.least("id_a", "id_b").alias("n_a"), F.greatest("id_a", "id_b").alias("n_b")).agg(F.bit_or(bit).alias("kinds"))
    weights = lambda s: norms.select(F.col("n").alias(f"n_{s}"), F.col("weight_of").alias(f"weight_of_{s}"))
    floor = F.least(*[F.when(F.col("kinds").bitwiseAND(1 << k) > 0, _least(k, min_score, volume_weight, form_weight)) for k in range(4)], F.lit(2.0))
    scored = spread(met).join(weights("a"), "n_a").join(weights("b"), "n_b").select("block", "n_a", "n_b", cosine(F.col("weight_of_a"), F.col("weight_of_b")).alias("cosine"), "kinds")
    equal = names.select("block", F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(1.0).alias("cosine"), F.lit(15).alias("kinds")).distinct()
    return scored.where(F.col("cosine") >= floor - SLACK).unionByName(equal)


def joined_names(names: DataFrame, vectors: DataFrame, volume_agreement, form_agreement, min_score: float, volume_weight: float, form_weight: float, slice_size: int = SLICE) -> DataFrame:
    """id_a <= id_b, cosine, volume and form (how the two agree) of the names of one brand that may reach min_score; each pair once.

    names: id, brand_norm, norm, vol, form, only (the source of a name that just one has; two names of that one are no pair, nor is such a name with
    itself), each (brand_norm, norm, vol, form) once. vectors: norm, grams, weight_of, each norm once.
    """
    norms = computed_once(vectors.withColumn("n", F.monotonically_increasing_id()))
    names = computed_once(names.join(norms.select("norm", "n"), "norm").select("id", "n", F.xxhash64("brand_norm").alias("block"), "brand_norm", "vol", "form", "only"))
    close = spread(computed_once(close_norms(names, norms, min_score, volume_weight, form_weight, slice_size)))
    side = lambda s, *more: names.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "brand_norm", "vol", "form", "only")], *more)
    unit, micros = F.col("vol.unit").alias("unit"), _millionths(F.col("vol.amount"))
    known = F.col("vol_a").isNotNull()
    volume, form = volume_agreement(F.col("vol_a"), F.col("vol_b")), form_agreement(F.col("form_a"), F.col("form_b"))
    by_volume = close.where(F.col("kinds").bitwiseAND(2 | 8) > 0).join(side("a", unit, F.explode(F.sequence(micros - 1, micros + 1)).alias("micros")).where(known), ["block", "n_a"])
    by_volume = by_volume.join(side("b", unit, micros.alias("micros")), ["block", "n_b", "unit", "micros"]).drop("unit", "micros").where(volume == 1)
    others = close.where(F.col("kinds").bitwiseAND(1 | 4) > 0).join(side("a"), ["block", "n_a"]).join(side("b"), ["block", "n_b"]).where(volume != 1)
    met = by_volume.unionByName(others).where("brand_norm_a = brand_norm_b and (n_a < n_b or id_a <= id_b)").where(F.coalesce(F.col("only_a") != F.col("only_b"), F.lit(True)))
    met = met.where(F.col("cosine") >= least_cosine(volume, form, min_score, volume_weight, form_weight) - SLACK)
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine", volume.alias("volume"), form.alias("form"))


def candidate_pairs(names: DataFrame, volume_agreement, form_agreement, min_score: float, volume_weight: float, form_weight: float, slice_size: int = SLICE) -> DataFrame:
    """As joined_names, from names that carry their vectors (grams, weight_of)."""
    vectors = names.select("norm", "grams", "weight_of").dropDuplicates(["norm"])
    return joined_names(names.drop("grams", "weight_of"), vectors, volume_agreement, form_agreement, min_score, volume_weight, form_weight, slice_size)
