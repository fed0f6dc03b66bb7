import random
import string

from pyspark.sql import functions as F

from quillspan.llm import overlap as V
from tests.conftest import rows

FILES = "file_id bigint, ref_id bigint, filename string, sha256 string, split_name string, url string, body string"
REFS = "ref_id bigint, url string, source string, file_id string"
H = "ab" * 32


def run(spark, files, refs=()):
    f = spark.createDataFrame([(k, r, n, h, s, "x", "y") for k, r, n, h, s in files], FILES)
    return V.file_pairs(f, spark.createDataFrame([(*r, "q") for r in refs], REFS))


NAMES = [
    ("A1000-01_Bid_Set_Plans_Vol_2.pdf", True),
    ("a1000 01 BID SET PLANS VOL 2.PDF", True),
    ("Bid-Set-Plans-Vol-2-A1000_01.pdf", True),
    ("A1000%2001%20Bid%20Set%20Plans%20Vol%202.pdf", True),
    ("Copy of A100001_Bid_Set_Plans_Vol_2 (3).pdf", True),
    ("A1000-01_Bid_Set_Plans_Vol_2 - Copy.pdf", True),
    ("A1000-01_Bid_Set_Plans_Vol_2-Copy (3).pdf", True),
    ("A1000-01_Bid_Set_Plans_Vol_2_copy.pdf", True),
    ("A1000-01_Bid_Set_Plns_Vol_2.pdf", True),
    ("A1000-01_Bid_Set_Plaans_Vol_2.pdf", True),
    ("A1000-01_Bid_Set_Plxns_Vol_2.pdf", True),
    ("A1000-01_Bid_Set_Palns_Vol_2.pdf", True),
    ("A1000-01_Bid_Set_Palsn_Vol_2.pdf", False),
    ("A1000-01_Bid_Set_Plans_Vol_3.pdf", False),
    ("A1000-01_Bid_Set_Plans_Vol_2.dwg", False),
    ("A1000-02_Bid_Set_Plans_Vol_2.pdf", False),
    ("A1000-01_Bid_Set_Details_Vol_2.pdf", False),
    ("Bid_Set_Plans_Vol_2.pdf", False),
    ("", False),
    (None, False),
]


def test_names(spark):
    files = [(0, 0, NAMES[0][0], None, "train")] + [(k, k, n, None, "test") for k, (n, _) in enumerate(NAMES, 1)]
    assert rows(run(spark, files), "file_a", "file_b") == sorted(((0, k) for k, (_, near) in enumerate(NAMES, 1) if near), key=repr)


def typo(rng, s):
    k = rng.randrange(len(s) - 1) if len(s) > 1 else 0
    c = rng.choice(string.ascii_lowercase)
    return rng.choice([s[:k] + c + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + s[k : k + 2][::-1] + s[k + 2 :]])


def near(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        d = [k for k in range(len(a)) if a[k] != b[k]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_no_link_is_lost(spark):
    """Short, long and repetitive names in one block against all pairs."""
    rng = random.Random(9)
    words = ["a", "ab", "aa", "abcde", "planset", "recordsetplans", "issuedforconstructionmechanicalplansheets", "aaaaaaaaaaaaaaa", "abababababababab", "x" * 300]
    names = words + [typo(rng, w) for w in words for _ in range(12)] + [typo(rng, typo(rng, w)) for w in words for _ in range(4)]
    files = [(k, k, f"Q1234-56 {n}.pdf", None, rng.choice(["train", " VAL", "Test", None, "other"])) for k, n in enumerate(names)]
    side = lambda s: {"train": 1, " VAL": 2, "Test": 2}.get(s)
    want = {
        (min(a[0], b[0]), max(a[0], b[0])) for a in files for b in files
        if side(a[4]) == 1 and side(b[4]) == 2 and near(names[a[0]], names[b[0]])
    }
    got = run(spark, files)
    assert rows(got, "file_a", "file_b") == sorted(want, key=repr) and want


def test_names_of_few_letter_pairs(spark):
    """One typo in a long run of one letter: pairs that the bands (fixed seeds) miss."""
    typos = [("z" * 15, "ü" + "z" * 14), ("h" * 15, "ä" + "h" * 14), ("h" * 15, "ñ" + "h" * 14), ("ç" * 15, "l" + "ç" * 14)]
    files = [(2 * k + side, None, f"A100{k}-01 {name}.pdf", None, "test" if side else "train") for k, pair in enumerate(typos) for side, name in enumerate(pair)]
    assert rows(run(spark, files), "file_a", "file_b") == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_hashes(spark):
    same = [H, H.upper(), f"sha256:{H}", f" {H}\n"]
    files = [(1, 1, None, H, "train")] + [(k + 2, 1, None, h, "val") for k, h in enumerate(same)]
    void = ["0" * 64, None, "", "x", V._EMPTY_SHA256]
    files += [(k + 20, 1, None, h, s) for k, h in enumerate(void) for s in ("train",)] + [(k + 40, 1, None, h, "test") for k, h in enumerate(void)]
    assert rows(run(spark, files), "file_a", "file_b", "by_hash", "by_name") == [(1, k, True, False) for k in range(2, 6)]


def test_addresses(spark):
    base = "https://host.example/bids/a1/plan_set?id=7"
    same = ["HTTP://www.HOST.example:80/bids/a1/plan_set/?utm=1&id=7#page=2", "https://host.example:443//bids/a1/plan%5Fset?id=7", base]
    other = ["https://host.example/bids/a1/plan_set?id=8", "https://host.example/bids/a2/plan_set?id=7", "https://else.example/bids/a1/plan_set?id=7", "https://host.example/bids/a1/plan_set?pid=7", None]
    refs = [(1, base, "s")] + [(k + 2, u, "s") for k, u in enumerate(same + other)]
    files = [(1, 1, None, None, "train")] + [(k + 2, k + 2, None, None, "test") for k in range(len(same + other))]
    assert rows(run(spark, files, refs + refs[:2]), "file_a", "file_b", "by_url") == [(1, 2, True), (1, 3, True), (1, 4, True)]


def test_report_counts_files(spark):
    f = spark.createDataFrame([(1, 1, None, H, "train", "x", "y"), (2, 2, None, H, "test", "x", "y"), (3, 2, None, None, "test", "x", "y"), (3, 2, None, None, "test", "x", "y"), (4, 3, None, H, "valid", "x", "y")], FILES)
    r = spark.createDataFrame([(2, None, "City-Parks", "q"), (2, None, "city parks", "q"), (3, None, None, "q")], REFS)
    assert rows(V.report(f, r)) == [("test", "cityparks", 2, 1, 1, 0, 0), ("validation", None, 1, 1, 1, 0, 0)]
    assert V.report(f.where("false"), r).count() == V.file_pairs(f.where("false"), r.where("false")).count() == 0


def test_jaccard_is_exact(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert sorted(df.select(V.shingles(F.col("t"))).first()[0]) == ["^a", "ab", "bc", "c$"]
