"""Pattern facts that need more than one row: site contacts and address completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.functions import text as X

# Shortest stretch that ends in a state and a five-digit ZIP: equal for an address and for every
# description that starts with it, so the prefix join can run as an equi-join.
ADDRESS_KEY = r"^.*? [a-z]{2} \d{5}"


def contact_report(texts: DataFrame, key: str) -> DataFrame:
    """Distinct e-mails and phones per key as rows, with the number of texts that show them.

    Rows, not arrays: a key with very many contacts stays spread over the cluster.
    """
    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(tagged("email", X.emails(F.col("text"))), tagged("phone", X.phones(F.col("text"))))
    return (
        texts.select(key, F.explode(found).alias("hit"))
        .groupBy(key, F.col("hit.kind").alias("kind"), F.col("hit.value").alias("value"))
        .agg(F.count("*").alias("n_pages"))
    )


def _address_key(column: str):
    return F.regexp_extract(F.lower(F.col(column)), ADDRESS_KEY, 0)


def complete_addresses(found: DataFrame, places: DataFrame) -> DataFrame:
    """Replace each address by the descriptions that start with it.

    ``found`` is ``(unit, address ARRAY)``, ``places`` is ``(description)``.  Each distinct address is
    completed once.
    """
    asked = found.select("unit", F.explode("address").alias("asked"))
    wanted = asked.select("asked").distinct().withColumn("_key", _address_key("asked"))
    known = places.select("description").distinct().withColumn("_key", _address_key("description"))
    hits = (
        wanted.join(known, "_key")
        .where(F.lower(F.col("description")).startswith(F.lower(F.col("asked"))))
        .select("asked", "description")
    )
    done = asked.join(hits, "asked").groupBy("unit").agg(F.array_sort(F.collect_set("description")).alias("address"))
    none = F.array().cast("array<string>")
    return found.select("unit").join(done, "unit", "left").withColumn("address", F.coalesce("address", none))
