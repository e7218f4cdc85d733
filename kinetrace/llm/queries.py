"""Queries of the operators for training data, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import RECORD_WIDTH, table
from ..shared import materialize
from . import encoding, packing, pieces, quantiles, splits, tokens


#: Array columns whose percentiles are asked for: table, column, width, and the day a row belongs to.
WIDE = (
    ("umr_release", "features", RECORD_WIDTH, "ingested_at"), ("norm_stats", "packed_clip_p01", RECORD_WIDTH, "stat_day"),
    ("norm_stats", "packed_clip_p99", RECORD_WIDTH, "stat_day"), ("feature_fields", "root_traj", 9, "recorded_at"),
)


def _fields(spark, sf_dir):
    """(field, column, width, rows with source and day) of each array column."""
    for name, column, width, day in WIDE:
        yield column, width, table(spark, sf_dir, name).select(F.lit(column).alias("field"), "source", F.to_date(day).alias("day"), column)


def _digests(spark, sf_dir, by, percents=None):
    """One digest of each field and key, all fields in one table; with ``percents``, read."""
    raw, parts = None, 1
    for column, width, rows in _fields(spark, sf_dir):
        one, n = quantiles.partials(rows, column, width, ["field", *by])
        raw, parts = one if raw is None else raw.unionByName(one), max(parts, n)
    return quantiles.tree(raw, parts, ["field", *by], percents)


def p2_percentiles(spark, sf_dir):
    """Percentiles of every source and dimension of all fields."""
    return _digests(spark, sf_dir, ["source"], quantiles.PERCENTS)


def p2_days(spark, sf_dir):
    """Percentiles of every source, day and dimension of all fields."""
    return _digests(spark, sf_dir, ["source", "day"], quantiles.PERCENTS)


def p2_from_days(spark, sf_dir):
    """Percentiles per source and dimension, combined from the digests of single days."""
    days = _digests(spark, sf_dir, ["source", "day"])
    day = F.datediff(F.coalesce("day", F.lit("1969-12-31")), F.lit("1970-01-01"))
    most = 1 << 16  # days, from 1970 on, numbered so that many of them are added in a tree
    return quantiles.tree(days.select("field", "source", "block", "nodes", "counts", F.pmod(day, F.lit(most)).alias("part")), most, ["field", "source"], quantiles.PERCENTS)


def p2_rank_error(spark, sf_dir):
    """Values of every field, source and dimension, and whether every answer lies within the stated rank error."""
    values = None
    for column, width, rows in _fields(spark, sf_dir):
        one = rows.where(f"size({column}) % {width} = 0").select("field", "source", F.posexplode(column).alias("i", "x")).select("field", "source", (F.col("i") % width).alias("dim"), F.col("x").cast("double").alias("x"))
        values = one if values is None else values.unionByName(one)
    values = values.where("x is not null and not isnan(x) and abs(x) < double('inf')")
    e = quantiles.rank_errors(values, materialize(p2_percentiles(spark, sf_dir)), ["field", "source"])
    return e.select("field", "source", "dim", "n", (F.col("worst") <= quantiles.ERROR).alias("within"))


def p3_pieces(spark, sf_dir):
    """Pieces of at most 300 records, 30 of them shared, of every longer clip."""
    names = ("umr_release", "clip_plans", "event_tracks", "recordings", "capture_sources")
    return pieces.pieces(*(table(spark, sf_dir, n) for n in names))


def p3_sound(spark, sf_dir):
    """Length of every item that is cut up, and whether its pieces cover it, within the limit and with the stated overlap."""
    return pieces.sound(p3_pieces(spark, sf_dir)).select("table_name", "item_id", "row_key", "length", "sound")


def p3_found(spark, sf_dir):
    """Items longer than 300 records."""
    return p3_pieces(spark, sf_dir).select("table_name", "item_id").distinct()


def p4_found(spark, sf_dir):
    """Pairs of a training row and an evaluation row with the same or nearly the same content."""
    return splits.pairs_of_rows(splits.overlaps(table(spark, sf_dir, "umr_release"), materialize))


def p4_links(spark, sf_dir):
    """Every evaluation row that occurs in training, its class by each test, and how many training rows it is linked to."""
    return splits.links_of_rows(splits.overlaps(table(spark, sf_dir, "umr_release"), materialize))


def p4_ids(spark, sf_dir):
    """Pairs by the id alone."""
    return splits.pairs_of_rows([splits.id_overlap(splits.sides(table(spark, sf_dir, "umr_release")))])


def p4_report(spark, sf_dir):
    """Overlaps per test, evaluation split and source."""
    umr = table(spark, sf_dir, "umr_release")
    return splits.report(splits.overlaps(umr, materialize), umr)


def p5_ids(spark, sf_dir):
    """doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p5_round_trip(spark, sf_dir):
    """Bytes of every document, and whether its ids decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decode_ids(tokens.encode_texts(docs)).withColumnRenamed("text", "back")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return docs.join(back, "doc_id").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), same.alias("same"))


def p6_sound(spark, sf_dir):
    """Texts in containers, whether no container is over-full and no text without need split, and whether 99 % of the space is used
    (but for one container of each group)."""
    packed = materialize(packing.pack_texts(table(spark, sf_dir, "documents")))
    fill = packing.fill(packed).agg(F.min("unused").alias("least"), F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    split = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size"))
    # a piece is a full container but for a text's last one
    whole = split.agg(F.bool_and(F.col("pieces") == F.greatest(F.ceil(F.col("size") / packing.CAPACITY), F.lit(1))).alias("whole"), F.count("*").alias("n_docs"))
    groups = packed.agg(F.count_distinct(F.shiftright("container", 32)).alias("groups"))
    full = F.col("used") >= 0.99 * packing.CAPACITY * (F.col("n") - F.col("groups"))
    return whole.crossJoin(fill).crossJoin(groups).select("n_docs", (F.col("least") >= 0).alias("fits"), "whole", full.alias("full"))  # one row each


def p6_pack(spark, sf_dir):
    """Container of every text, 2,048 tokens each."""
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p6_fill(spark, sf_dir):
    """Fill of every container."""
    return packing.fill(packing.pack_texts(table(spark, sf_dir, "documents")))


def p7_found(spark, sf_dir):
    """Documents with garbled characters from a wrong decoding."""
    return encoding.garbled(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p7_restored(spark, sf_dir):
    """Garbled documents with their original text where it could be restored."""
    return encoding.garbled(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (p2_percentiles, p2_days, p2_from_days, p2_rank_error, p3_found, p3_pieces, p3_sound, p4_found, p4_links, p4_ids, p4_report, p5_ids, p5_round_trip, p6_pack, p6_fill, p6_sound, p7_found, p7_restored)}
_VALUES = " union all ".join(f"select '{column}' as field, source, cast((i - 1) % {width} as int) as dim, x::double as x from (select source, unnest({column}) as x, generate_subscripts({column}, 1) as i from {name} where len({column}) % {width} = 0)" for name, column, width, _ in WIDE)
_PLANS = """plans as (select clip_id, num_frames, row_number() over (partition by clip_id order by planned_at desc, num_frames desc) as k
               from clip_plans where error is null and clip_id is not null)"""
_LONG = "case when features is not null then len(features) // 499 else num_records end"
SQL = {
    "p3_sound": f"""with {_PLANS} select 'umr_release' as table_name, rec_id as item_id, row_id as row_key, cast({_LONG} as int) as length, true as sound from umr_release where rec_id is not null and {_LONG} > 300
union all select 'clip_plans', clip_id, null, num_frames, true from plans where k = 1 and num_frames > 300""",
    "p5_round_trip": "select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes, true as same from documents",
    "p6_sound": "select count(distinct doc_id) as n_docs, true as fits, true as whole, true as full from documents",
    "p4_ids": """
with k as (select row_id, lower(trim(split)) = 'train' as train, regexp_replace(regexp_replace(lower(trim(rec_id)), '[^a-z0-9]+(?:r|rev|revision|v|ver|version)[^a-z0-9]*[0-9]+[^a-z0-9]*$', ''), '[^a-z0-9]', '', 'g') as key
           from umr_release where lower(trim(split)) in ('train', 'val', 'test') and row_id is not null and rec_id is not null)
select distinct least(a.row_id, b.row_id) as row_id_a, greatest(a.row_id, b.row_id) as row_id_b from k a join k b on a.key = b.key where a.train and not b.train and a.key <> ''
""",
    "p2_rank_error": f"select field, source, dim, count(*) as n, true as within from ({_VALUES}) where isfinite(x) group by field, source, dim",
    "p3_found": """
with plans as (select clip_id, num_frames, row_number() over (partition by clip_id order by planned_at desc, num_frames desc) as k
               from clip_plans where error is null and clip_id is not null)
select distinct 'umr_release' as table_name, rec_id as item_id from umr_release
where rec_id is not null and case when features is not null then len(features) // 499 else num_records end > 300
union all
select 'clip_plans', clip_id from plans where k = 1 and num_frames > 300
"""
}
