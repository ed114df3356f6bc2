"""Differences between two copies of a table.

Both sides are reduced to the highest revision of every key by an aggregate that combines before
the shuffle, so a key that holds a third of all rows costs one row per input partition. The two
sides then meet in one null-safe full outer join on the key, in the partitions that they already have (one shuffle a side); values are compared in a normal form
and land in an array of (item, field, left value, right value).

Defined results for odd input: empty tables give no rows for a pair of empty sides, and "only on
one side" rows otherwise; a null key is a key like any other (null-safe join) and is given as null;
null or empty ``entries`` count as no entries; an entry without a channel is matched under the
channel ''; repeated rows of one revision collapse to the greatest of them in the order of
``tie_break``; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are used as hyphen or minus sign.
HYPHENS = "‐‑‒–—―−﹘﹣－"
BLANKS = "[\\s   -     　]+"


def normal_value(value: Column) -> Column:
    """Lower case, one kind of hyphen, single inner blanks, none around; null equals ''."""
    one_hyphen = F.translate(value, HYPHENS, "-" * len(HYPHENS))
    return F.coalesce(F.lower(F.trim(F.regexp_replace(one_hyphen, BLANKS, " "))), F.lit(""))


def normal_id(value: Column) -> Column:
    """Upper case with '-' for '_' and for other hyphens, without surrounding blanks."""
    return F.upper(F.trim(F.regexp_replace(F.translate(value, HYPHENS + "_", "-" * (len(HYPHENS) + 1)), BLANKS, " ")))


def highest_revision(df: DataFrame, key: Column, revision: str, payload: Sequence[Column], tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per key: the payload of the row with the greatest (revision, tie_break).

    Rows are grouped by the two columns (``KEY``) that the null-safe join compares, so the join needs no further shuffle.
    """
    order = [F.col(revision), *(F.col(c) for c in tie_break)]
    picked = df.select(*_join_key(key), F.struct(F.struct(*order).alias("rank"), F.struct(*payload).alias("row")).alias("candidate"))
    best = picked.groupBy(*KEY).agg(F.max("candidate").alias("best"))
    return best.select(F.when(~F.col(KEY[1]), F.col(KEY[0])).alias("key"), *KEY, "best.row.*")


#: Columns by which keys are compared null-safe with plain equality.
KEY = ("__key", "__key_is_null")


def _join_key(key: Column) -> list[Column]:
    return [F.coalesce(key.cast("string"), F.lit("")).alias(KEY[0]), key.isNull().alias(KEY[1])]


def diff_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Flat copies: one row per key that is missing on a side or differs.

    Gives ``keys``, ``kind`` ('only_left', 'only_right', 'differs') and ``differences``, an array of
    (field, left_value, right_value) with the values as written. Keys are compared null-safe and
    must be unique on each side.
    """
    a = left.select(*(F.col(k).alias(f"__lk{i}") for i, k in enumerate(keys)), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("__l"))
    b = right.select(*(F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("__r"))
    on = [F.col(f"__lk{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(len(keys))]
    joined = a.join(b, on, "full_outer")
    per_field = [
        F.when(normal_value(F.col("__l")[f]) != normal_value(F.col("__r")[f]), F.struct(F.lit(f).alias("field"), F.col("__l")[f].alias("left_value"), F.col("__r")[f].alias("right_value")))
        for f in fields
    ]
    kind = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").otherwise("differs")
    out = joined.select(
        *(F.coalesce(F.col(f"__lk{i}"), F.col(f"__rk{i}")).alias(k) for i, k in enumerate(keys)),
        kind.alias("kind"),
        F.when(kind == "differs", F.array_compact(F.array(*per_field))).alias("differences"),
    )
    return out.filter((F.col("kind") != "differs") | (F.size("differences") > 0))


def _by_channel(entries: Column, fields: Sequence[str]) -> Column:
    """Channel -> values as written; the first entry of a channel counts."""
    channels = F.transform(entries, lambda e: F.coalesce(e["channel"], F.lit("")))
    numbered = F.transform(entries, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    firsts = F.transform(F.filter(numbered, lambda x: F.array_position(channels, F.coalesce(x["e"]["channel"], F.lit(""))) == x["i"] + 1), lambda x: x["e"])
    unique = F.when(F.size(F.array_distinct(channels)) == F.size(channels), entries).otherwise(firsts)
    return F.map_from_entries(F.transform(unique, lambda e: F.struct(F.coalesce(e["channel"], F.lit("")), F.array(*(e[f].cast("string") for f in fields)))))


def diff_nested(left: DataFrame, right: DataFrame, entry_fields: Sequence[str], row_fields: Sequence[str]) -> DataFrame:
    """Copies with one row per key and an array of entries per row.

    ``left`` and ``right`` have ``key``, ``entries`` (array of structs with ``channel``) and the
    ``row_fields`` (strings). Gives key, in_left, in_right and ``differences``, an array of
    (channel, field, kind, left_value, right_value): field 'row' for a key on one side only, 'entry'
    for an entry on one side only, otherwise the field's name with kind 'differs'.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        entries = F.coalesce(F.filter("entries", lambda e: e.isNotNull()), F.array())
        values = [F.col(f"`{f}`").cast("string") for f in row_fields]
        compared = list(KEY) if set(KEY) <= set(df.columns) else _join_key(F.col("key"))
        return df.select(F.col("key").alias(f"key_{s}"), *compared, _by_channel(entries, entry_fields).alias(f"e_{s}"), F.array(*values).alias(f"r_{s}"))

    j = side(left, "l").join(side(right, "r"), list(KEY), "full_outer")
    in_l, in_r = F.col("r_l").isNotNull(), F.col("r_r").isNotNull()
    nothing = F.lit(None).cast("string")

    def entry(channel: Column, field: Column, kind: str, lv: Column = nothing, rv: Column = nothing) -> Column:
        return F.struct(channel.alias("channel"), field.alias("field"), F.lit(kind).alias("kind"), lv.alias("left_value"), rv.alias("right_value"))

    def differing(channel: Column, names: Sequence[str], a: Column, b: Column) -> Column:
        # Most values are letter for letter the same; only the others are brought into normal form.
        same = lambda x, y: x.eqNullSafe(y) | (normal_value(x) == normal_value(y))
        every = F.transform(F.array(*map(F.lit, names)), lambda f, i: F.when(~same(F.get(a, i), F.get(b, i)), entry(channel, f, "differs", F.get(a, i), F.get(b, i))))
        return F.array_compact(every)

    def compare(x: Column) -> Column:
        one_sided = lambda kind: F.array(entry(x["ch"], F.lit("entry"), kind))
        return F.when(x["b"].isNull(), one_sided("only_left")).when(x["a"].isNull(), one_sided("only_right")).otherwise(differing(x["ch"], entry_fields, x["a"], x["b"]))

    met = j.withColumn("__met", F.transform(F.array_union(F.map_keys("e_l"), F.map_keys("e_r")), lambda ch: F.struct(ch.alias("ch"), F.try_element_at("e_l", ch).alias("a"), F.try_element_at("e_r", ch).alias("b"))))
    whole = lambda kind: F.array(entry(F.lit(""), F.lit("row"), kind))
    both = F.concat(differing(F.lit(""), row_fields, F.col("r_l"), F.col("r_r")), F.flatten(F.transform("__met", compare)))
    differences = F.when(~in_r, whole("only_left")).when(~in_l, whole("only_right")).otherwise(both)
    return met.select(F.coalesce("key_l", "key_r").alias("key"), in_l.alias("in_left"), in_r.alias("in_right"), differences.alias("differences"))
