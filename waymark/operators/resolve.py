"""Entity resolution: identity keys, known records, merges by key, by name, and by connected keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import present
from .graph import components
from .ordered import first_present, in_order, union_in_order

CONTACTS = ("website", "instagram", "facebook", "whatsapp", "phone", "email", "address")
TRI_STATE = ("business_type", "fashion_relevance", "women_fashion_relevance", "physical_store")
CONFIDENCE = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def identity_keys() -> dict[str, Column]:
    """Kind to key of a record (website, instagram, phone, business_name, city); null where the record has none."""
    return {
        "website": urls.key_domain(F.col("website")),
        "instagram": urls.key_instagram(F.col("instagram")),
        "phone": urls.key_phone(F.col("phone")),
        "name_city": urls.key_name_city(F.col("business_name"), F.col("city")),
    }


def keyed(records: DataFrame, id_col: str = "seq", keys: dict[str, Column] | None = None) -> DataFrame:
    """(id, kind, key): one row for each key that a record has."""
    made = keys or identity_keys()
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in made.items()])
    return records.select(id_col, F.explode(F.filter(pairs, lambda x: x["key"].isNotNull())).alias("k")).select(id_col, "k.kind", "k.key")


def new_records(records: DataFrame, known: DataFrame, id_col: str = "seq", keys: dict[str, Column] | None = None) -> DataFrame:
    """Records none of whose keys is a key of a known record."""
    seen = keyed(known, id_col, keys).select("kind", "key").distinct()
    hit = keyed(records, id_col, keys).join(seen, ["kind", "key"], "left_semi").select(id_col).distinct()
    return records.join(hit, id_col, "left_anti")


def same_pairs(left: DataFrame, right: DataFrame, id_col: str = "seq") -> DataFrame:
    """(left_id, right_id, kinds) of records that share a key."""
    a = keyed(left, id_col).withColumnRenamed(id_col, "left_id")
    b = keyed(right, id_col).withColumnRenamed(id_col, "right_id")
    return a.join(b, ["kind", "key"]).groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def duplicate_key() -> Column:
    """The record's first key, tagged with its kind; null without any."""
    return F.coalesce(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v)) for k, v in identity_keys().items()])


def fold(records: DataFrame, group: Sequence[str], order: str = "seq") -> DataFrame:
    """One row for each group: the left-to-right merge of its records as plain aggregates.

    Contacts and city are the first present ones, three-state fields the first
    that aren't UNKNOWN, confidence the highest, the name the one of highest
    rank (first of equals), lists are united in order.
    """
    o = F.col(order)
    aggregates = [first_present(F.col(c), o, F.coalesce(F.col(c) != "", F.lit(False))).alias(c) for c in CONTACTS if c in records.columns]
    aggregates += [F.coalesce(first_present(F.col(c), o, present(F.col(c))), F.lit("UNKNOWN")).alias(c) for c in ("city", *TRI_STATE) if c in records.columns]
    if "confidence" in records.columns:
        level = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()], F.lit(0))
        aggregates.append(F.max_by("confidence", F.struct(level, -o)).alias("confidence"))
    rank = F.col("name_rank") if "name_rank" in records.columns else F.lit(0)
    aggregates.append(F.coalesce(F.max_by(F.when(present(F.col("business_name")), F.col("business_name")), F.when(present(F.col("business_name")), F.struct(rank, -o))), F.lit("UNKNOWN")).alias("business_name"))
    aggregates += [union_in_order(F.col(c), o).alias(c) for c in ("discovered_by_queries", "signals") if c in records.columns]
    if "source_url" in records.columns:
        aggregates += [F.min_by("source_url", o).alias("source_url"), F.array_distinct(in_order(F.col("source_url"), o)).alias("merged_source_urls")]
    aggregates += [F.array_distinct(in_order(F.when(F.col("phone") != "", F.col("phone")), o)).alias("phones"), F.array_distinct(in_order(F.when(F.col("email") != "", F.col("email")), o)).alias("emails")]
    return records.groupBy(*group).agg(F.min(o).alias(order), F.count(F.lit(1)).alias("n_merged"), *aggregates)


def merge_by_first_key(records: DataFrame, order: str = "seq") -> DataFrame:
    """Merges records with equal first keys; keyless ones stay alone. Not transitive: a record has one key only."""
    key = F.coalesce(duplicate_key(), F.concat(F.lit("row:"), F.col(order).cast("string")))
    return fold(records.withColumn("merge_key", key), ["merge_key"], order)


def merge_same_name(records: DataFrame, order: str = "seq") -> DataFrame:
    """(order, merged_into): each record's place in a greedy merge of equal names.

    A record joins the first earlier one of its name that, merged so far, has no
    different domain, account, phone or city. The comparison is with the merged
    record, so a name's records are folded in order, one name at a time. Records
    of one name with the same four facts share one place, the first one's: what
    it was merged with stays compatible, and what conflicted goes on to. So a
    block holds the different facts of one exact name and not its records.
    """
    keys = identity_keys()
    named = records.where(present(F.col("business_name"))).select(
        F.lower(F.btrim(F.regexp_replace("business_name", r"\s+", " "))).alias("name"), F.col(order).cast("long").alias("o"),
        keys["website"].alias("d"), keys["instagram"].alias("i"), keys["phone"].alias("p"), F.when(present(F.col("city")), F.lower(F.btrim("city"))).alias("c"),
    )

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        into = []
        rows = pdf.sort_values("o")
        for o, *facts in rows[["o", "d", "i", "p", "c"]].itertuples(index=False):
            facts = [None if pd.isna(f) else f for f in facts]
            for k in kept:
                if all(a is None or b is None or a == b for a, b in zip(k[1], facts)):
                    k[1] = [b if a is None else a for a, b in zip(k[1], facts)]
                    into.append(k[0])
                    break
            else:
                kept.append([o, facts])
                into.append(o)
        return pd.DataFrame({"o": rows["o"].to_numpy(), "merged_into": into})

    facts = ("name", "d", "i", "p", "c")
    same = named.groupBy(*facts).agg(F.min("o").alias("o"))
    merged = same.groupBy("name").applyInPandas(greedy, "o long, merged_into long").withColumnRenamed("o", "first")
    match = F.lit(True)
    for c in facts:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    placed = named.alias("l").join(same.withColumnRenamed("o", "first").alias("r"), match).select(F.col("l.o").alias("o"), "first").join(merged, "first").select("o", "merged_into")
    return records.select(F.col(order).cast("long").alias("o")).join(placed, "o", "left").select(F.col("o").alias(order), F.coalesce("merged_into", "o").alias("merged_into"))


def claims(records: DataFrame, order: str = "seq", strict: bool = False, keys: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges to the first claimer of each key, and pairs of equal name and city that were kept apart.

    Only the name-and-city key checks whether the two records have different
    websites or accounts, and only against its first claimer; with strict, a
    phone does too.
    """
    keys = keys or identity_keys()
    known = records.select(F.col(order).alias("id"), keys["website"].alias("site"), keys["instagram"].alias("account"))
    claimed = keyed(records, order, keys).withColumnRenamed(order, "id")
    # the first claimer is a partial aggregate, so a key that very many records share isn't sorted in one task
    claimed = claimed.join(claimed.groupBy("kind", "key").agg(F.min("id").alias("first")), ["kind", "key"]).where("id <> first")
    first = known.select(F.col("id").alias("first"), F.col("site").alias("first_site"), F.col("account").alias("first_account"))
    facing = claimed.join(known, "id").join(first, "first")
    conflict = F.coalesce(F.col("site") != F.col("first_site"), F.lit(False)) | F.coalesce(F.col("account") != F.col("first_account"), F.lit(False))
    checked = F.col("kind").isin(*(("name_city", "phone") if strict else ("name_city",)))
    facing = facing.withColumn("apart", conflict & checked)
    return facing.where("NOT apart").select("id", "first"), facing.where("apart").select("kind", "key", F.col("first").alias("left_id"), F.col("id").alias("right_id"))


def merge_connected(records: DataFrame, order: str = "seq", strict: bool = False, keys: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records merged over all chains of shared keys, and the ambiguous pairs."""
    edges, ambiguous = claims(records, order, strict, keys)
    found = components(edges, "id", "first")
    labelled = records.join(found.withColumnRenamed("node", order), order, "left").withColumn("component", F.coalesce("component", F.col(order)))
    return fold(labelled, ["component"], order), ambiguous


def ambiguous_names(merged: DataFrame, ambiguous: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """Names of ambiguous pairs, and names that more than one merged record has."""
    ids = ambiguous.select(F.explode(F.array("left_id", "right_id")).alias(order)).distinct()
    in_pairs = records.join(ids, order, "left_semi").select(F.lower("business_name").alias("name"))
    repeated = merged.where(present(F.col("business_name"))).groupBy(F.lower("business_name").alias("name")).count().where("count > 1").select("name")
    return in_pairs.unionByName(repeated).distinct()
