"""Translation catalogs as a table: lang, key, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATALOG_LANGUAGES, KEY_ALIASES, KEY_SYMBOLS
from ..functions.scale import salted_join


def lang_normalize(language: Column, languages: tuple[str, ...] = CATALOG_LANGUAGES) -> Column:
    """Catalog code of a language tag; unknown tags fall back to English."""
    tag = F.regexp_replace(F.lower(F.regexp_replace(language, r"(?U)^\s+|\s+$", "")), "_", "-")
    parts = F.split(tag, "-")
    primary = F.when(parts[0] == "", "en").otherwise(parts[0])
    has = lambda *subtags: F.arrays_overlap(parts, F.array(*[F.lit(s) for s in subtags]))
    code = (
        F.when((primary == "pt") & has("br"), "pb")
        .when((primary == "zh") & has("tw", "hant", "hk", "mo") & ~has("hans", "cn", "sg"), "tw")
        .when(primary.isin("nb", "nn"), "no")
        .otherwise(primary)
    )
    return F.when(code.isin(*languages), code).otherwise("en")


def canonical_key(key: Column) -> Column:
    out = key
    for alias, target in KEY_ALIASES.items():
        out = F.when(key == alias, target).otherwise(out)
    return F.when(key == "button.scan_plus", "scan").otherwise(out)


def substitute(text: Column, arguments: Column) -> Column:
    """Replace ``{name}`` for each argument, in order."""
    return F.aggregate(
        arguments,
        text,
        lambda acc, a: F.replace(acc, F.concat(F.lit("{"), a["name"], F.lit("}")), a["value"]),
    )


def translate_resolve(requests: DataFrame, translations: DataFrame, spread: str, arguments: str | None = None) -> DataFrame:
    """Attach ``text``: language, then English, then the key itself.

    ``requests``: language, key and ``spread``, a column that scatters equal
    keys, because a popular key may be most of the requests.
    """
    asked = requests.withColumn("_lang", lang_normalize(F.col("language"))).withColumn("_key", canonical_key(F.col("key")))
    local = translations.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), F.col("text").alias("_local"))
    english = translations.where("lang = 'en'").select(F.col("key").alias("_key"), F.col("text").alias("_english"))
    joined = salted_join(asked, local, ["_lang", "_key"], F.col(spread), "left")
    joined = salted_join(joined, english, ["_key"], F.col(spread), "left")
    text = F.coalesce("_local", "_english", "_key")
    text = F.when(F.col("key") == "button.scan_plus", F.concat(text, F.lit(" +1"))).otherwise(text)
    for key, symbol in KEY_SYMBOLS.items():
        text = F.when(F.col("key") == key, symbol).otherwise(text)
    if arguments:
        text = F.coalesce(substitute(text, F.col(arguments)), text)
    return joined.withColumn("text", text).select(*requests.columns, "text")


def catalog_gaps(translations: DataFrame) -> DataFrame:
    """Per language: keys English lacks and English keys it lacks."""
    english = translations.where("lang = 'en'").select("key").distinct()
    pairs = translations.select("lang", "key").distinct()
    extra = pairs.join(english, "key", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("extra"))
    total = english.agg(F.count(F.lit(1)).alias("english"))
    counts = pairs.groupBy("lang").agg(F.count(F.lit(1)).alias("keys"))
    sized = counts.join(extra, "lang", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    # One total row, matched by a constant key.
    joined = sized.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        "lang", "keys", "extra", (F.col("english") - (F.col("keys") - F.col("extra"))).alias("missing")
    )
