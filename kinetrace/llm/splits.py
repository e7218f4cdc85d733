"""Records of evaluation splits that occur, exactly or almost, in the training split.

Three tests name a pair: the same id but for writing and revision mark, near-equal
captions, near-equal motion.  The last two work alike: rows with equal content form a
class; each class has a MinHash signature of its shingles, cut into bands; only classes
that share a band and lie on different sides of the split are compared, by their exact
Jaccard similarity, short captions also by the number of changed words.  What comes out
are classes, their rows, and links between classes; rows are paired only where pairs of
rows are asked for, and counted from the sizes of the classes.

A caption's shingles are runs of three normalised words.  A motion's shingles are its
records, told apart by a few dimensions on a coarse grid; every hash function has dimensions
and a grid offset of its own, so that small differences move a record across a grid line
in some functions only.  Compared are then whole records: as many as can be paired in order,
of all records of either.

A band that very many training classes share is cut into parts, each of which meets all
evaluation classes of the band: no pair is lost, and no task grows with the band.  Motions
whose lengths alone rule out the similarity never meet.

Null, empty and short captions, null or ragged motions, null ids and rows in no known
split match nothing by that test.  Repeated rows are rows of their own.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 499
LEAST_WORDS = 12
SHINGLE = 3  #: words; five would leave too little of a caption with a few words changed
CAPTION_BANDS, CAPTION_ROWS, CAPTION_JACCARD = 128, 4, 0.45
CHANGED = 3  #: words put in, left out or replaced between near-equal short captions
SHORT = 28  #: words; below 26 on a side, so many changes leave too few shingles
MOTION_BANDS, MOTION_ROWS, MOTION_JACCARD = 48, 2, 0.7
MOTION_DIMS, GRID = 8, 0.08  #: dimensions and cell of one hash function of motions
NEAR = 0.012  #: difference within which two values of a motion are the same
ALIKE = 0.97  #: share of values alike in the same record
LOOK = 48  #: dimensions looked at first; all values that may differ could lie among them
HOT = 1024  #: training classes of a band that one task meets
BLOOM, BLOOM_BITS = 1 << 17, 3  #: words of 63 bits in the filter of candidate rows, 2 MB at any scale; bits a row sets
SEED = 7

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_FUNCTIONS = MOTION_BANDS * MOTION_ROWS
_DIMS = np.stack([_rng.choice(np.arange(15, 471), MOTION_DIMS, replace=False) for _ in range(_FUNCTIONS)])
_OFFSET = _rng.random((_FUNCTIONS, MOTION_DIMS)) * GRID
_COEF = _rng.integers(1, 1 << 63, (_FUNCTIONS, MOTION_DIMS), dtype=np.uint64) | np.uint64(1)
_MORE = CAPTION_BANDS * CAPTION_ROWS - 256  # drawn last: the others stay as they were
_MUL = np.r_[_MUL, _rng.integers(1, 1 << 63, _MORE, dtype=np.uint64) | np.uint64(1)]
_ADD = np.r_[_ADD, _rng.integers(0, 1 << 63, _MORE, dtype=np.uint64)]
_LOOK = np.linspace(9, 470, LOOK).astype(int)
WORD = re.compile(r"\w+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bands(signature: np.ndarray, rows: int) -> list[int]:
    """One 64-bit key per band, the band's number included."""
    s = signature.reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = _mix(key ^ s[:, k])
    return key.view(np.int64).tolist()


def caption_words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return WORD.findall(plain.casefold())


def caption_signature(words: list[str]) -> tuple[list[int], list[int]]:
    """Shingle hashes and band keys."""
    shingles = sorted({xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1)})
    h = np.array(shingles, np.uint64)
    with np.errstate(over="ignore"):
        least = _mix(h[:, None] * _MUL + _ADD).min(axis=0)
    return h.view(np.int64).tolist(), _bands(least, CAPTION_ROWS)


def _segments(n: int) -> list[tuple[int, int]]:
    """``CHANGED`` + 1 stretches of ``n`` words: that many changes leave one of them whole."""
    at = [n * k // (CHANGED + 1) for k in range(CHANGED + 2)]
    return list(zip(at, at[1:]))


def short_keys(words: list[str]) -> tuple[list[int], list[int]]:
    """Keys of a short caption's own stretches, and of all stretches that one within ``CHANGED`` words of it may have."""

    def key(n, k, part):
        return xxhash.xxh3_64_intdigest(f"{n}:{k}:{' '.join(part)}") - (1 << 63)

    n = len(words)
    own = [key(n, k, words[a:b]) for k, (a, b) in enumerate(_segments(n))]
    near = set()
    for m in range(n - CHANGED, n + CHANGED + 1):
        for k, (a, b) in enumerate(_segments(m)):
            for by in range(-CHANGED, CHANGED + 1):
                if 0 <= a + by and b + by <= n:
                    near.add(key(m, k, words[a + by : b + by]))
    return own, sorted(near)


def as_characters(words: list[str]) -> str:
    """A character for each word, so that the distance of strings is that of words."""
    return "".join(chr(0x10000 + xxhash.xxh3_64_intdigest(w) % 0x100000) for w in words)


def motion_signature(x: np.ndarray) -> list[int]:
    """Band keys of the records of a motion, but of bands with a function that finds no finite record."""
    v = x[:, _DIMS]  # records, functions, dimensions
    with np.errstate(over="ignore", invalid="ignore"):
        cell = np.floor((v + _OFFSET) / GRID)
        ok = np.isfinite(cell).all(axis=2)
        token = _mix((np.where(np.isfinite(cell), cell, 0).clip(-1e9, 1e9).astype(np.int64).view(np.uint64) * _COEF).sum(axis=2))
    token[~ok] = np.iinfo(np.uint64).max
    told = ok.any(axis=0).reshape(-1, MOTION_ROWS).all(axis=1)
    return [key for key, all_told in zip(_bands(token.min(axis=0), MOTION_ROWS), told) if all_told]


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (np.abs(x - y) <= NEAR) | (x == y) | (np.isnan(x) & np.isnan(y))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which records of ``a`` are the same as which of ``b``."""
    least = int(np.ceil(ALIKE * WIDTH - 1e-9))
    out = np.zeros((len(a), len(b)), bool)
    rows = max(1, (1 << 21) // (LOOK * max(1, len(b))))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(_close(a[at : at + rows, None, _LOOK], b[None, :, _LOOK]).sum(axis=2) >= LOOK - (WIDTH - least))
        for k in range(0, len(i), 4096):
            x, y = i[k : k + 4096], j[k : k + 4096]
            out[x + at, y] = _close(a[x + at], b[y]).sum(axis=1) >= least
    return out


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Most records of ``a`` and ``b`` that can be paired, each with the same record, in order."""
    same = alike(a, b)
    best = np.zeros(len(b) + 1, np.int32)
    for row in same:  # longest common subsequence, a row at a time
        if row.any():
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row))
    return int(best[-1])


def same_motion(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of the records, counted exactly."""
    if min(len(a), len(b)) < MOTION_JACCARD * max(len(a), len(b)):
        return False
    m = matched(a, b)
    return m >= MOTION_JACCARD * (len(a) + len(b) - m)


def sides(umr: DataFrame) -> DataFrame:
    """The rows with their side of the split as ``_train``; rows in no known split are left out."""
    split = F.lower(F.trim("split"))
    return umr.where(split.isin("train", "val", "test") & F.col("row_id").isNotNull()).withColumn("_train", split == "train")


def id_key(rec_id: str = "rec_id"):
    """Id without case, separators and revision mark."""
    bare = F.regexp_replace(F.lower(F.trim(F.col(rec_id))), r"[^a-z0-9]+(?:r|rev|revision|v|ver|version)[^a-z0-9]*[0-9]+[^a-z0-9]*$", "")
    key = F.regexp_replace(bare, "[^a-z0-9]", "")
    return F.when(key != "", key)


@dataclass(frozen=True)
class Overlap:
    """Classes of rows that one test takes for the same, and pairs of different classes it takes for nearly so."""

    kind: str
    members: DataFrame  #: (cls, row_id, _train)
    links: DataFrame | None  #: (ct, ce): a class with training rows, one with evaluation rows

    def linked(self) -> DataFrame:
        """(ct, ce), classes on both sides linked to themselves."""
        own = self.members.groupBy("cls").agg(F.max("_train").alias("t"), F.max(~F.col("_train")).alias("e")).where("t and e").select(F.col("cls").alias("ct"), F.col("cls").alias("ce"))
        return own if self.links is None else own.unionByName(self.links)

    def row_pairs(self) -> DataFrame:
        """(t, e): every training row and evaluation row of linked classes."""
        t = self.members.where("_train").select(F.col("cls").alias("ct"), F.col("row_id").alias("t"))
        e = self.members.where("not _train").select(F.col("cls").alias("ce"), F.col("row_id").alias("e"))
        return self.linked().join(t, "ct").join(e, "ce").select("t", "e")


def _classes(signed: DataFrame, *keep: str) -> DataFrame:
    """One row per class with its sides; combined before the shuffle, so copies weigh nothing."""
    return signed.groupBy("cls").agg(*(F.first(k).alias(k) for k in keep), F.min("row_id").alias("rep"), F.max("_train").alias("on_train"), F.max(~F.col("_train")).alias("on_eval"))


def _candidates(classes: DataFrame, train: str = "bands", other: str = "bands", size: str | None = None, ratio: float = 0.5) -> DataFrame:
    """(ct, ce): different classes of different sides that share a band.

    With ``size``, only classes of which the smaller has at least about ``ratio`` of the
    larger's size meet: none that fulfils it is left out.
    """
    step = F.floor(F.ln(F.col(size)) / F.lit(np.log(1 / ratio))).cast("int") if size else F.lit(0)
    t = classes.where("on_train").select(F.col("cls").alias("ct"), step.alias("step"), F.explode(train).alias("band"))
    e = classes.where("on_eval").select(F.col("cls").alias("ce"), step.alias("step"), F.explode(other).alias("band"))
    if size:
        e = e.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    key = ["band", "step"]
    hot = t.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*key, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    t = t.join(hot, key, "left").select("ct", *key, F.pmod(F.xxhash64("ct"), parts).cast("int").alias("part"))
    e = e.join(hot, key, "left").select("ce", *key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return t.join(e, [*key, "part"]).where("ct != ce").select("ct", "ce").distinct()


def caption_overlap(rows: DataFrame) -> Overlap:
    """Near-equal captions of at least ``LEAST_WORDS`` words."""

    def work(batches):
        for batch in batches:
            out = []
            for row, text, train in zip(*(batch.column(c).to_pylist() for c in ("row_id", "text", "_train"))):
                words = caption_words(text)
                if len(words) >= LEAST_WORDS:
                    shingles, bands = caption_signature(words)
                    own, near = short_keys(words) if len(words) <= SHORT else ([], [])
                    code = as_characters(words) if len(words) <= SHORT else None
                    out.append({"row_id": row, "_train": train, "cls": xxhash.xxh3_128_hexdigest(" ".join(words)), "shingles": shingles, "bands": bands, "own": own, "near": near, "code": code})
            if out:
                i64 = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row_id", pa.int64()), ("_train", pa.bool_()), ("cls", pa.string()), ("shingles", i64), ("bands", i64), ("own", i64), ("near", i64), ("code", pa.string())]))

    signed = rows.where("text is not null").select("row_id", "text", "_train").mapInArrow(work, "row_id long, _train boolean, cls string, shingles array<long>, bands array<long>, own array<long>, near array<long>, code string")
    classes = _classes(signed, "shingles", "bands", "own", "near", "code")
    keyed = classes.withColumn("own", F.concat("bands", "own")).withColumn("near", F.concat("bands", "near"))
    held = classes.select("cls", "shingles", "code")
    both = (
        _candidates(keyed, "own", "near")
        .join(held.select(F.col("cls").alias("ct"), F.col("shingles").alias("st"), F.col("code").alias("wt")), "ct")
        .join(held.select(F.col("cls").alias("ce"), F.col("shingles").alias("se"), F.col("code").alias("we")), "ce")
    )
    shared = F.size(F.array_intersect("st", "se"))
    alike = shared >= CAPTION_JACCARD * (F.size("st") + F.size("se") - shared)
    near = both.where(alike | F.coalesce(F.levenshtein("wt", "we", CHANGED) >= 0, F.lit(False))).select("ct", "ce")
    return Overlap("caption", signed.select("cls", "row_id", "_train"), near)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose row_id is among ``ids``, sifted by a filter of fixed size before the join."""
    word = F.pmod(F.xxhash64("row_id"), F.lit(BLOOM))
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(pmod(xxhash64(row_id, {k}), 63) as int))" for k in range(BLOOM_BITS)))
    words = ids.select(word.alias("_at"), mask.alias("_mask")).groupBy("_at").agg(F.bit_or("_mask").alias("_word"))
    sifted = rows.withColumn("_at", word).withColumn("_mask", mask).join(F.broadcast(words), "_at").where(F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return sifted.drop("_at", "_mask", "_word").join(ids, "row_id", "left_semi")


def motion_overlap(rows: DataFrame, checkpoint) -> Overlap:
    """Near-equal motions.  The wide table is read twice: for the signatures, and for the
    motions of candidates, which are written and compared from there."""

    def sign(batches):
        for batch in batches:
            out = []
            ids, train, cls = (batch.column(c).to_pylist() for c in ("row_id", "_train", "cls"))
            column = batch.column("features")
            off, v = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(ids):
                bands = motion_signature(v[off[i] : off[i + 1]].reshape(-1, WIDTH))
                out.append({"row_id": k, "_train": train[i], "cls": cls[i], "records": int(off[i + 1] - off[i]) // WIDTH, "bands": bands})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row_id", pa.int64()), ("_train", pa.bool_()), ("cls", pa.string()), ("records", pa.int32()), ("bands", pa.list_(pa.int64()))]))

    def verify(batches):
        for batch in batches:
            keep = []
            a, b = (batch.column(c) for c in ("a", "b"))
            oa, ob = a.offsets.to_numpy(), b.offsets.to_numpy()
            va, vb = (c.values.to_numpy(zero_copy_only=False) for c in (a, b))
            for i in range(len(batch)):
                x, y = va[oa[i] : oa[i + 1]].reshape(-1, WIDTH), vb[ob[i] : ob[i + 1]].reshape(-1, WIDTH)
                keep.append(same_motion(x, y))
            yield pa.RecordBatch.from_arrays([batch.column("ct").filter(pa.array(keep)), batch.column("ce").filter(pa.array(keep))], ["ct", "ce"])

    moving = rows.where(f"size(features) > 0 and size(features) % {WIDTH} = 0").select("row_id", "_train", "features")
    cls = F.concat_ws(":", F.xxhash64("features"), F.hash("features"), F.size("features"))
    signed = checkpoint(moving.withColumn("cls", cls).mapInArrow(sign, "row_id long, _train boolean, cls string, records int, bands array<long>"))
    classes = _classes(signed, "bands", "records")
    reps = classes.select("cls", "rep")
    pairs = checkpoint(
        _candidates(classes, size="records", ratio=MOTION_JACCARD).join(reps.select(F.col("cls").alias("ct"), F.col("rep").alias("ra")), "ct").join(reps.select(F.col("cls").alias("ce"), F.col("rep").alias("rb")), "ce")
    )
    wanted = pairs.select(F.col("ra").alias("row_id")).unionByName(pairs.select(F.col("rb").alias("row_id"))).distinct()
    motions = checkpoint(_only(moving.select("row_id", "features"), wanted))
    both = pairs.join(motions.select(F.col("row_id").alias("ra"), F.col("features").alias("a")), "ra").join(motions.select(F.col("row_id").alias("rb"), F.col("features").alias("b")), "rb")
    near = both.select("ct", "ce", "a", "b").mapInArrow(verify, "ct string, ce string")
    return Overlap("motion", signed.select("cls", "row_id", "_train"), near)


def id_overlap(rows: DataFrame) -> Overlap:
    return Overlap("id", rows.select(id_key().alias("cls"), "row_id", "_train").where("cls is not null"), None)


def overlaps(umr: DataFrame, checkpoint) -> list[Overlap]:
    """What each of the three tests finds; each is written, as several results are made of it."""
    rows = sides(umr)
    out = []
    for o in (id_overlap(rows), caption_overlap(rows), motion_overlap(rows, checkpoint)):
        out.append(o if o.links is None else Overlap(o.kind, o.members, checkpoint(o.links)))
    return out


def pairs_of_rows(found: list[Overlap]) -> DataFrame:
    """Distinct (row_id_a, row_id_b), the smaller first."""
    out = None
    for o in found:
        one = o.row_pairs().select(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _partners(o: Overlap) -> DataFrame:
    """(cls, n_partners) of evaluation classes: training rows linked to each."""
    size = o.members.where("_train").groupBy(F.col("cls").alias("ct")).agg(F.count("*").alias("n"))
    return o.linked().join(size, "ct").groupBy(F.col("ce").alias("cls")).agg(F.sum("n").alias("n_partners"))


def links_of_rows(found: list[Overlap]) -> DataFrame:
    """(row_id, kind, cls, n_links): the class of every evaluation row with an overlap, and its training partners."""
    out = None
    for o in found:
        one = o.members.where("not _train").join(_partners(o), "cls").select("row_id", F.lit(o.kind).alias("kind"), "cls", F.col("n_partners").alias("n_links"))
        out = one if out is None else out.unionByName(one)
    return out


def report(found: list[Overlap], umr: DataFrame) -> DataFrame:
    """(kind, split, source, n_pairs, n_rows): confirmed pairs and evaluation rows in any, per
    test, split and source; and of kind ``any`` the rows that some test finds (its pairs are null,
    as tests can find the same).  Counted from the links of classes, not from pairs."""
    rows = links_of_rows(found).join(umr.select("row_id", "split", "source"), "row_id")
    per = rows.groupBy("kind", "split", "source").agg(F.sum("n_links").alias("n_pairs"), F.count("*").alias("n_rows"))
    any_ = rows.groupBy("split", "source").agg(F.count_distinct("row_id").alias("n_rows"))
    return per.unionByName(any_.select(F.lit("any").alias("kind"), "split", "source", F.lit(None).cast("long").alias("n_pairs"), "n_rows"))
