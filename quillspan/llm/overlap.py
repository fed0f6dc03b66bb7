"""The same or nearly the same files across splits.

Every file is described by up to three facets: the hash of its content, the address it was got from and its name.
A facet is a block, which must agree exactly, and a body, of which a set of shingles is taken: hash and address are
one shingle each, names have the letter pairs of their letters. Minwise hashes of the shingles are cut into bands;
descriptions of one block that share a band's bucket are candidates if one is of the training split and the other of
an evaluation split. Candidates are verified by the exact Jaccard similarity that one typo leaves at least, then by the
typo itself, and only then expanded to files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.common import cut

BANDS, ROWS = 40, 2
#: Names with fewer letters have too few shingles for bands to be sure; every form with one letter left out is a bucket.
SHORT = 12
#: The same goes for names of at most so many distinct letter pairs, however long. One typo changes three of them at most.
FEW, CHANGED = 12, 3

# Spellings of the splits, and the SHA-256 of empty content.
_SPLITS = {"train": ("train", "training", "trn"), "validation": ("validation", "valid", "val", "dev"), "test": ("test", "testing", "tst")}
_EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_GAP = r"[\s_.\-‐-―]*"
_CODE = rf"(?<![a-z0-9])([a-z]){_GAP}(\d{{4}}){_GAP}(\d{{2}})(?!\d)"


def canonical_split(c: Column) -> Column:
    """train, validation or test in whatever spelling; null for anything else."""
    word = F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", "")
    out = F.lit(None).cast("string")
    for name, spellings in _SPLITS.items():
        out = F.when(word.isin(*spellings), name).otherwise(out)
    return out


def canonical_source(c: Column) -> Column:
    """Letter case, blanks, hyphens and underscores don't matter."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", "")


def _hash_key(c: Column) -> Column:
    digits = F.regexp_extract(F.lower(c), r"(?U)^\s*(?:sha-?256[:=]?)?\s*([0-9a-f]{64})\s*$", 1)
    return F.when((digits != "") & ~digits.rlike("^0+$") & (digits != _EMPTY_SHA256), digits)


def _url_key(c: Column) -> Column:
    """Host, path and ``id`` of an address; scheme, port, a leading www., encoding and all else are indifferent."""
    part = lambda n: F.regexp_extract(F.trim(c), r"(?i)^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?", n)
    plain = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.|\.$", "")
    path = F.regexp_replace(F.regexp_replace(plain(part(2)), "/{2,}", "/"), "/+$", "")
    number = plain(F.regexp_extract(part(3), r"(?i)(?:^|[&;])id=([^&;]*)", 1))
    return F.when(host != "", F.concat_ws("\x1f", host, path, number))


def _name_parts(names: Column) -> dict[str, Column]:
    """Block (project code, extension, other numbers in order) and body (other letters) of a file name."""
    plain = F.lower(F.coalesce(F.try_url_decode(names), names))
    stem, ext = F.regexp_extract(plain, r"(?s)^(.*?)(?:\.([a-z0-9]{1,5}))?\s*$", 1), F.regexp_extract(plain, r"(?s)^(.*?)(?:\.([a-z0-9]{1,5}))?\s*$", 2)
    stem = F.regexp_replace(stem, r"^\s*(?:copy[\s_\-]+of[\s_\-]+)+", "")
    stem = F.regexp_replace(stem, r"(?:[\s_\-]*\(\d+\)|[\s_\-]+copy|_\d+_)+[\s_]*$", "")
    code = F.when(stem.rlike(_CODE), F.concat(*[F.regexp_extract(stem, _CODE, k) for k in (1, 2, 3)]))
    rest = F.regexp_replace(stem, rf"^(.*?){_CODE}", "$1 ")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+)"), 1), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    return {"block": F.concat_ws("|", code, ext, F.array_join(numbers, ",")), "body": F.regexp_replace(rest, r"[^\p{L}]", ""), "code": code}


def _members(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, split, facet, block, body): what each file of a known split can be recognised by."""
    own = files.select("file_id", "ref_id", canonical_split(F.col("split_name")).alias("split"), "filename", "sha256").where(F.col("split").isNotNull() & F.col("file_id").isNotNull()).distinct()
    url = refs.select("ref_id", _url_key(F.col("url")).alias("body")).where(F.col("body").isNotNull()).distinct()
    name = _name_parts(F.col("filename"))
    frame = lambda facet, block, body: [F.lit(facet).alias("facet"), block.alias("block"), body.alias("body")]
    by_hash = own.select("file_id", "split", *frame("hash", F.lit(""), _hash_key(F.col("sha256"))))
    by_url = own.join(url, "ref_id").select("file_id", "split", *frame("url", F.lit(""), F.col("body")))
    by_name = own.where(name["code"].isNotNull()).select("file_id", "split", *frame("name", name["block"], name["body"]))
    return by_hash.unionByName(by_url).unionByName(by_name).where(F.col("body").isNotNull()).distinct()


def shingles(body: Column) -> Column:
    """Pairs of neighbouring letters, the ends marked."""
    marked = F.concat(F.lit("^"), body, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda k: F.substring(marked, k, F.lit(2))))


def _buckets(body: Column, pairs: Column) -> Column:
    """Banded minwise hashes of the shingles; of bodies that are short or of few shingles, the body and its forms with
    one letter left out. Next to the limits both, so that two bodies one typo apart always have one kind in common."""
    least = lambda seed: F.array_min(F.transform(pairs, lambda s: F.xxhash64(s, seed)))
    banded = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda k: F.xxhash64(F.concat(F.substring(body, F.lit(1), k - 1), F.substring(body, k + 1, F.length(body)))))
    forms = F.array_distinct(F.concat(F.array(F.xxhash64(body)), cut))
    exact = (F.length(body) <= SHORT) | (F.size(pairs) <= FEW + CHANGED)
    bands = (F.length(body) >= SHORT) & (F.size(pairs) > FEW)
    return F.when(exact & bands, F.concat(forms, banded)).when(exact, forms).otherwise(banded)


def _one_typo(a: Column, b: Column) -> Column:
    """At most one letter mistyped, missing or added, or two neighbours swapped."""
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.length(a)), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))), False).cast("int")
    swapped = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, F.length(a)))
    near = F.levenshtein(a, b, 2)
    return (near.between(0, 1)) | ((near == 2) & (F.length(a) == F.length(b)) & (swapped == b))


def _overlaps(members: DataFrame) -> DataFrame:
    """(facet, block, train_body, eval_body, jaccard) of descriptions that occur in training and in evaluation."""
    train = F.col("split") == "train"
    items = members.groupBy("facet", "block", "body").agg(F.max(train).alias("in_train"), F.max(~train).alias("in_eval"))
    same = items.where("in_train AND in_eval").select("facet", "block", F.col("body").alias("train_body"), F.col("body").alias("eval_body"), F.lit(1.0).alias("jaccard"))
    names = items.where("facet = 'name'")
    # Blocks with one name, or names on one side only, have no candidates: they aren't hashed.
    open_blocks = names.groupBy("block").agg(F.count("*").alias("n"), F.max("in_train").alias("t"), F.max("in_eval").alias("e")).where("n > 1 AND t AND e").select("block")
    banded = names.join(open_blocks, "block", "left_semi").withColumn("pairs", shingles(F.col("body")))
    banded = banded.withColumn("bucket", F.explode(_buckets(F.col("body"), F.col("pairs"))))
    left = banded.where("in_train").select("block", "bucket", F.col("body").alias("train_body"))
    right = banded.where("in_eval").select("block", "bucket", F.col("body").alias("eval_body"))
    near = left.join(right, ["block", "bucket"]).where("train_body <> eval_body").select("block", "train_body", "eval_body").distinct()
    # One typo changes at most ``CHANGED`` pairs on either side, which bounds the similarity of two names from below.
    near = near.withColumns({"a": shingles(F.col("train_body")), "b": shingles(F.col("eval_body"))})
    most = F.greatest(F.size("a"), F.size("b"))
    near = near.withColumn("jaccard", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    near = near.where((F.col("jaccard") >= (most - CHANGED) / (most + CHANGED)) & _one_typo(F.col("train_body"), F.col("eval_body")))
    near = near.select(F.lit("name").alias("facet"), "block", "train_body", "eval_body", "jaccard")
    return same.unionByName(near)


def file_pairs(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_a, file_b, by_hash, by_url, by_name): every pair of a training and an evaluation file that agree.

    Files of a null or unknown split are in no pair. Null, void and all-zero hashes, the hash of empty content, null
    addresses and names without a project code say nothing. Rows delivered twice count once; empty tables give an
    empty result. Pairs follow from the two files alone.
    """
    members = cut(_members(files, refs))
    train = members.where("split = 'train'").select("facet", "block", F.col("body").alias("train_body"), F.col("file_id").alias("t"))
    held = members.where("split <> 'train'").select("facet", "block", F.col("body").alias("eval_body"), F.col("file_id").alias("e"))
    pairs = _overlaps(members).join(train, ["facet", "block", "train_body"]).join(held, ["facet", "block", "eval_body"])
    by = lambda f: F.max(F.col("facet") == f).alias(f"by_{f}")
    return pairs.groupBy(F.least("t", "e").alias("file_a"), F.greatest("t", "e").alias("file_b")).agg(by("hash"), by("url"), by("name"))


def report(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(split, source, n_files, n_overlapping, by_hash, by_url, by_name): evaluation files that are also in training.

    Counts files, not pairs, so groups of copies of any size cost no more than their rows. ``source`` is that of the
    file's ref, spelled canonically; null if it has none.
    """
    every = cut(_members(files, refs))
    members = every.where("split <> 'train'")
    hit = _overlaps(every).select("facet", "block", F.col("eval_body").alias("body")).distinct()
    by = lambda f: F.max(F.col("facet") == f).alias(f)
    flags = members.join(hit, ["facet", "block", "body"], "left_semi").groupBy("file_id").agg(by("hash"), by("url"), by("name"))
    source = refs.groupBy("ref_id").agg(F.min(F.nullif(canonical_source(F.col("source")), F.lit(""))).alias("source"))
    held = files.select("file_id", "ref_id", canonical_split(F.col("split_name")).alias("split")).where("split <> 'train' AND file_id IS NOT NULL").distinct()
    count = lambda c, n: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n)
    return (
        held.join(source, "ref_id", "left").join(flags, "file_id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("n_files"), count(F.col("hash").isNotNull(), "n_overlapping"), *[count(F.col(f), f"by_{f}") for f in ("hash", "url", "name")])
    )
