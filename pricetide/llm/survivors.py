"""The surviving record of each duplicate group, chosen field by field.

What the candidates of a group state is broken into claims, a value under a key:
the brand, line, model and technical attributes of a name, the brand, the
entries of specs, each image.  A placeholder is no claim.  Whether a claim is
true is a latent variable.  A source that states another value under the same
key denies the claim; one without a value for the key is silent, which says
nothing.  Each source has, per field, a sensitivity (how often it states what is
true) and a specificity (how often it leaves out what is false), both learned by
expectation-maximisation from the keys under which sources differ, until they
stand still.  Of the values of such a key at least one is true; all may be, so a
field of several values keeps every one judged true.  Images never deny each other.
A candidate is as complete in a field as it states claims judged true; among
equally complete ones the source's trust level, then the date decides.

The rounds are joins and sums on the executors over the statements of contested
keys alone: neither claims nor the table of sources come to the driver or have a
bound, and a key that millions fill is summed before it is shuffled.

Defined results: groups with a null id are left out; a null source is a source of
its own; a null trust level or date counts as lowest; a full tie goes to the
smaller candidate_id; repeated rows of one candidate count once; a field without
any true claim has no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.batch_dedup import brand_words
from pricetide.llm.product_phrases import PhraseReader, attributes, mine_lines
from pricetide.llm.words import fold
from pricetide.session import checkpointed

#: Beta priors as (hits, misses), worth ten observations beside those of the data at any size.
PRIOR_SENSITIVITY = (8.0, 2.0)
PRIOR_FALSE = (1.0, 9.0)
#: How likely it is beforehand that all values of a contested key are true, beside each of them being the only one.
ALL_TRUE = 0.2
JUDGED_TRUE = 0.5
#: The rounds end when no sensitivity or specificity moves by this much, at the latest after ``MOST_ROUNDS``.
STILL, MOST_ROUNDS = 0.01, 40
FIELDS = ("canonical_name", "brand", "specs", "image_url")

# Texts that stand for a missing value.
PLACEHOLDERS = ("", "-", "--", "?", "??", "???", "n/a", "na", "n.a.", "unknown", "inconnu", "inconnue", "none", "null", "nil", "aucun", "aucune", "sans marque", "no name", "noname", "generique", "generic", "autre", "other", "oem", "divers", "misc", "voir fiche", "tbd", "x", "xx", "xxx", "non specifie", "non renseigne", "a completer")
PLACEHOLDER_IMAGE = r"(?i)placeholder|no[-_]?image|default/|image[-_]?not[-_]?(found|available)|coming[-_]?soon|/blank\."


def real_text(value: Column) -> Column:
    """The value without case and blanks around it, or null where it says nothing."""
    t = F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " ")))
    return F.when(~t.isin(*PLACEHOLDERS) & t.rlike(r"[\p{L}\p{N}]"), t)


def real_image(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.rlike(r"^(?:https?:)?//\S+\.\S+/\S+|^/\S+\.\w{3,4}$") & ~t.rlike(PLACEHOLDER_IMAGE), t)


def claims(candidates: DataFrame, brands: list[str], lines: list[str]) -> DataFrame:
    """group_id, candidate_id, source, field, entry, key, value: one row for each thing that a candidate states.

    ``key`` and ``value`` are in canonical form, ``entry`` tells apart entries of one specs map that share them.
    """
    rows = candidates.where("group_id is not null and candidate_id is not null").select(
        F.col("group_id").cast("long").alias("group_id"), F.col("candidate_id").cast("long").alias("candidate_id"),
        F.coalesce(F.col("source_id").cast("long"), F.lit(-1).cast("long")).alias("source"), "canonical_name", "brand", "specs", "image_url",
    )
    pairs = "array<struct<key:string,value:string>>"

    def name_facts(names: pd.Series) -> pd.Series:
        reader = PhraseReader(brands, lines)
        out = []
        for n in names:
            r = reader.read(n if isinstance(n, str) else None)
            out.append([(k, v) for k, v in (("brand", r.brand), ("line", r.line), ("model", r.model), *r.attributes) if v])
        return pd.Series([[{"key": k, "value": v} for k, v in facts] for facts in out])

    def canonical_brand(typed: pd.Series) -> pd.Series:
        reader = PhraseReader(brands, ())
        return typed.map(lambda b: (reader.read(b).brand or fold(b)) if isinstance(b, str) else None)

    def canonical_value(value: pd.Series) -> pd.Series:
        def form(v: str) -> str:
            text = fold(v)
            return " ".join(f"{k}={x}" for k, x in sorted(attributes(text).items())) or text

        return value.map(lambda v: form(v) if isinstance(v, str) else None)

    facts, brand_of, value_of = F.pandas_udf(name_facts, pairs), F.pandas_udf(canonical_brand, "string"), F.pandas_udf(canonical_value, "string")
    who = ["group_id", "candidate_id", "source"]

    def told(field: str, entry: Column | str, key: Column, value: Column) -> list:
        return [*who, F.lit(field).alias("field"), F.lit(entry).alias("entry") if isinstance(entry, str) else entry.alias("entry"), key.alias("key"), value.alias("value")]

    names = rows.select(*who, F.explode(facts("canonical_name")).alias("f")).select(*told("canonical_name", "", F.col("f.key"), F.col("f.value")))
    brand = rows.select(*who, real_text(F.col("brand")).alias("v")).where("v is not null").select(*told("brand", "", F.lit("brand"), brand_of("v")))
    specs = rows.select(*who, F.explode("specs").alias("k", "v")).where(real_text(F.col("v")).isNotNull()).select(*told("specs", F.col("k"), F.lower(F.trim("k")), value_of("v")))
    image = rows.select(*who, real_image(F.col("image_url")).alias("v")).where("v is not null").select(*told("image_url", "", F.col("v"), F.col("v")))
    return names.unionByName(brand).unionByName(specs).unionByName(image).distinct()


_KEY = ["group_id", "field", "key"]


def _beliefs(votes: DataFrame, quality: DataFrame) -> DataFrame:
    """group_id, field, key, value, p: how likely each value of the contested keys is true."""
    ln = F.log
    known = votes.join(quality, ["source", "field"])
    said = known.groupBy(*_KEY, "value").agg(
        F.sum(ln("sens") - ln(1 - F.col("sens"))).alias("a"), F.sum(ln("false") - ln(1 - F.col("false"))).alias("b"))
    filled = known.select(*_KEY, "source", "sens", "false").distinct().groupBy(*_KEY).agg(F.sum(ln(1 - F.col("sens"))).alias("da"), F.sum(ln(1 - F.col("false"))).alias("db"))
    each = said.join(filled, _KEY).select(*_KEY, "value", (F.col("a") + F.col("da")).alias("if_true"), (F.col("b") + F.col("db")).alias("if_false"))
    whole = each.groupBy(*_KEY).agg(
        (F.sum("if_true") - F.sum("if_false") + F.log(F.lit(ALL_TRUE))).alias("all_true"), F.max(F.col("if_true") - F.col("if_false")).alias("top"))
    top = F.greatest("top", "all_true")
    weighed = each.join(whole, _KEY).withColumns({"alone": F.exp(F.col("if_true") - F.col("if_false") - top), "together": F.exp(F.col("all_true") - top)})
    total = weighed.groupBy(*_KEY).agg(F.sum("alone").alias("sum"))
    return weighed.join(total, _KEY).select(*_KEY, "value", ((F.col("alone") + F.col("together")) / (F.col("sum") + F.col("together"))).alias("p"))


def _quality(votes: DataFrame, beliefs: DataFrame, agreed: DataFrame) -> DataFrame:
    """source, field, sens, false of a round; ``agreed`` counts the keys whose fillers all say the same."""
    (a, b), (c, d) = PRIOR_SENSITIVITY, PRIOR_FALSE
    per_key = beliefs.groupBy(*_KEY).agg(F.sum("p").alias("all_p"), F.count("*").alias("n"))
    said = votes.join(beliefs, [*_KEY, "value"]).groupBy(*_KEY, "source").agg(F.sum("p").alias("tp"), F.sum(1 - F.col("p")).alias("fp"))
    held = said.join(per_key, _KEY).groupBy("source", "field").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum(F.col("all_p") - F.col("tp")).alias("fn"), F.sum(F.col("n") - F.col("all_p") - F.col("fp")).alias("tn"))
    known = held.join(agreed, ["source", "field"], "left").withColumn("tp", F.col("tp") + F.coalesce("n_agreed", F.lit(0)))
    return known.select(
        "source", "field", ((F.col("tp") + a) / (F.col("tp") + F.greatest("fn", F.lit(0.0)) + a + b)).alias("sens"),
        ((F.col("fp") + c) / (F.col("fp") + F.greatest("tn", F.lit(0.0)) + c + d)).alias("false"))


def judged_false(stated: DataFrame) -> DataFrame:
    """group_id, field, key, value of the claims that the two-sided quality model rejects."""
    told = stated.select(*_KEY, "value", "source").distinct()
    sizes = told.groupBy(*_KEY).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    contested = sizes.where("low <> high").select(*_KEY)
    votes = checkpointed(told.join(contested, _KEY, "left_semi"))
    if votes.isEmpty():
        return votes.select(*_KEY, "value")
    agreed = checkpointed(told.join(contested, _KEY, "left_anti").groupBy("source", "field").agg(F.count("*").alias("n_agreed")))
    start = [F.lit(x / (x + y)).alias(name) for (x, y), name in ((PRIOR_SENSITIVITY, "sens"), (PRIOR_FALSE, "false"))]
    quality, moved, rounds = checkpointed(votes.select("source", "field").distinct().select("source", "field", *start)), 1.0, 0
    while moved > STILL and rounds < MOST_ROUNDS:
        following = checkpointed(_quality(votes, _beliefs(votes, quality), agreed))
        old = quality.select("source", "field", F.col("sens").alias("s"), F.col("false").alias("f"))
        change = F.greatest(F.abs(F.col("sens") - F.col("s")), F.abs(F.col("false") - F.col("f")))
        moved = following.join(old, ["source", "field"]).agg(F.max(change)).first()[0]
        quality, rounds = following, rounds + 1
    beliefs = checkpointed(_beliefs(votes, quality))
    best = beliefs.groupBy(*_KEY).agg(F.max("p").alias("best"))
    # values that nothing tells apart stay together
    return beliefs.join(best, _KEY).where((F.col("p") < JUDGED_TRUE) & (F.col("p") < F.col("best") - 1e-6)).select(*_KEY, "value")


def survivors(candidates: DataFrame, sources: DataFrame, ref_values: DataFrame) -> DataFrame:
    """group_id, field_name, candidate_id of the candidate that supplies each surviving value."""
    brands = brand_words(ref_values)
    lines = mine_lines(candidates, "canonical_name", brands)
    stated = checkpointed(claims(candidates, brands, lines))
    true = stated.join(judged_false(stated), ["group_id", "field", "key", "value"], "left_anti")
    complete = true.groupBy("group_id", "field", "candidate_id").agg(F.count("*").alias("n"))
    trust = sources.groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.max("trust_level").alias("trust"))
    about = candidates.select(F.col("candidate_id").cast("long").alias("candidate_id"), F.col("source_id").cast("long").alias("source_id"), "updated_at").join(trust, "source_id", "left")
    about = about.groupBy("candidate_id").agg(F.max(F.struct(F.coalesce("trust", F.lit(-1)).alias("trust"), F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))).alias("at"))).alias("a"))
    ranked = complete.join(about, "candidate_id")
    best = ranked.groupBy("group_id", "field").agg(F.max(F.struct("n", "a.trust", "a.at", (-F.col("candidate_id")).alias("tie"))).alias("best"))
    return best.select("group_id", F.col("field").alias("field_name"), (-F.col("best.tie")).alias("candidate_id"))
