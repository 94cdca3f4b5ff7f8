"""Filter audit, Merkle manifest and decontamination against plain versions, on edge cases and on the smallest tables."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest

pytest.importorskip("lodestream.llm")

from pyspark.sql import functions as F

from lodestream.llm import decontaminate, filter_audit, merkle, queries

SF = "/root/testdata/sf0.001"
rng = random.Random(9)
WORDS = [f"w{k}" for k in range(40)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(14)
LONG = prose(30_000)
ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (2, "", "", "a"), (3, " \t\n", "de", None), (4, "One two\nthree", "en", ""), (4, "One two\nthree", "en", ""), (5, "One two\nthree", "de", "a"),
    (6, LONG, "en", "a"), (7, f"x {PASSAGE} y", "en", "b"), (8, PASSAGE.upper() + " " + PASSAGE, "fr", "b"), (9, " ".join(PASSAGE.split()[:6] + ["zz"] + PASSAGE.split()[6:]), "fr", "a"),
    (10, "short item", "fr", "a"), (11, "ab " * 300 + "# $", "fr", None), (12, "été élan " + "x" * 300 + " fin", "fr", "é"), (None, "One two\nthree", "en", "a"), (None, None, None, None), (13, LONG + " " + PASSAGE, "en", "a"),
    (14, "a\x00b\rc d", "en", "a"), *[(20 + k, "copied text of many\nlines", "en", "hot") for k in range(90)], *[(200 + k, prose(30) + "\n" + prose(3), "de", "hot") for k in range(60)],
]
MARKS = [(4, 1, 0), (5, 0, 1), (6, 1, None), (6, 0, 1), (7, 1, 1), (25, 1, 0), (None, 1, 1), (999, 1, 1)]
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "Short, ITEM!"), (4, ""), (5, None), (None, PASSAGE), (6, PASSAGE + " and more"), (7, "été élan " + "x" * 300), (10, prose(12)), (10, "copied text of")]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*row, None if row[1] is None else len(row[1])) for row in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("part", "mask", "grp", "idx", "key", "hash", "claim", "shard", "items", "n", "digest")}).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def mask(text):
    words = SPACE.findall(text)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3


def plain_audit(rows, marks):
    """Every order applied to every document."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = ({i for i, q, t in marks if i is not None and (q, t)[at] == 1} for at in (0, 1))
    parts = {}
    for i, text, lang, *_ in rows:
        parts.setdefault(lang or "", []).append((i, mask(text or "") | (i is not None and i > least[text or ""]) << 4))
    out, total = {}, {}
    for part, held in parts.items():
        for order in permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                failing = {k for k, (_, m) in enumerate(held) if m & bit}
                removed = failing - gone
                total[part, letter] = total.get((part, letter), 0) + len(removed)
                row = (len(held) - len(gone | failing), len(removed), len(failing & gone), sum(held[k][1] == bit for k in failing), sum(held[k][0] in good for k in removed), sum(held[k][0] in toxic for k in removed))
                out[part, "".join(order), step] = row
                gone |= failing
    return {k: (*row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_filter_audit_matches_every_order(spark, docs, empty):
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(ROWS, MARKS)
    assert len(got) == 600 * len({r[2] or "" for r in ROWS})
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_shapley_values_of_a_polynomial():
    counts = {m: rng.randrange(9) for m in range(32)}
    polynomial = filter_audit.Removal(counts, 5)
    for chosen in range(32):
        assert polynomial.corner(chosen) == sum(n for m, n in counts.items() if m & chosen)
    shares = [polynomial.shapley(k) for k in range(5)]
    assert sum(shares) == sum(n for m, n in counts.items() if m)  # nothing is left over
    assert shares == [sum(n / ones for m, n in ((m, filter_audit.Fraction(c)) for m, c in counts.items() if m >> k & 1) if (ones := m.bit_count())) for k in range(5)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """All levels in memory: (doc_id, leaf, subroot, root, proof, folded root, verified) of each row."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def steps(levels, at):
        for level in levels[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            yield "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
            at //= 3

    def original(i, text, lang, source, n):
        return sha("".join(map(field, (i, source, lang, n, text))))

    groups = {}
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        changed = text if text is None or i is None or zlib.crc32(str(i).encode()) % 2 else text.replace("\n", "")
        groups.setdefault(source, []).append((i is not None, i or 0, original(i, text, lang, source, n), original(i, changed, lang, source, n), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, true, claim, i) in enumerate(sorted(groups[s])):
            path = [*steps(trees[s], at), *steps(top, k)]
            h = claim
            for left, right in path:
                h = sha(left + h + right)
            out.append((i, true, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def test_manifest_matches_trees_in_memory(docs, empty):
    assert ordered(merkle.verify(docs).collect()) == ordered(plain_manifest(ROWS))
    assert merkle.verify(empty).count() == 0


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_in_several_bands(docs, height):
    """Bands of one or two levels: paths are handed down through several scans."""
    leaf = merkle.hashed(merkle.field_bytes(*[F.col(c) for c in merkle.FIELDS]))
    found = merkle.proofs(docs, leaf, F.lit(None).cast("binary"), height=height)
    text = F.lower(F.hex("hash"))
    got = found.select("key", text, "subroot", "root", F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256), merkle.folded(text, F.col("steps"))).collect()
    expected = [(*row[:5], row[3]) for row in plain_manifest(ROWS)]
    assert ordered(got) == ordered(expected)


def test_manifest_of_one_document(docs):
    (row,) = merkle.verify(docs.where("doc_id = 12")).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["verified"] and row["proof_sha256"] == sha("")


def plain_matches(rows, items):
    """Each window at each place: (doc_id, n_words, n_hit, n_items, digest, contaminated, n_near_items)."""
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        words = lower(text)
        if item is not None and words:
            for k in range(max(len(words) - 9, 1)):
                windows.setdefault(tuple(words[k : k + 10]), set()).add(str(item))
    out = []
    for i, text, *_ in rows:
        words, hit, found, near = lower(text), set(), set(), set()
        vocabulary = set(words)
        for terms, names in windows.items():
            if not set(terms) <= vocabulary:
                continue
            for s in range(-2, len(words)):
                if tuple(words[s : s + len(terms)]) == terms and s >= 0:
                    hit |= set(range(s, s + len(terms)))
                    found |= names
                if not names <= near and all(t in words[max(s + k - 2, 0) : max(s + k + 3, 0)] for k, t in enumerate(terms)):
                    near |= names
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit), len(near)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 900])
def test_decontamination_matches_every_place(spark, docs, empty, limit):
    """With 900 bytes a block the windows take several scans."""
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit("clash"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]
    got = decontaminate.report(docs, benchmark, limit)
    assert ordered(got.select(*names).collect()) == ordered(plain_matches(ROWS, ITEMS))
    if limit == 900:
        assert len(decontaminate.blocks_of(benchmark, [], limit)) > 2
    assert decontaminate.report(empty, benchmark, limit).count() == 0
    clean = decontaminate.report(docs, benchmark.where("false"), limit)
    assert clean.count() == len(ROWS) and clean.where("contaminated OR n_items > 0 OR n_near_items > 0").count() == 0


def test_decontamination_returns_spans_and_items(docs, spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.matches(docs, benchmark).collect()}
    assert [(h["start"], h["end"]) for h in rows[7]["hits"]] == [(1, 15)] and rows[7]["items"] == ["1", "2", "6"]
    assert rows[9]["hits"] == [] and {"1", "2"} <= set(rows[9]["near"])
    assert rows[10]["items"] == ["3"] and rows[12]["items"] == ["7"]


def test_windows_of_a_much_repeated_item_are_split(spark):
    benchmark = spark.range(50).select(F.col("id").alias("item_id"), F.lit(PASSAGE).alias("text"))
    split = decontaminate.windows(benchmark, item_group=10).collect()
    assert max(len(r["items"]) for r in split) < 30 and sum(len(r["items"]) for r in split) == 50 * 5
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    assert decontaminate.report(docs, benchmark).first()["n_items"] == 50


def test_a_text_is_split_between_words():
    text = b"AB" * 700_000 + b" c " + "é".encode() * 800_000 + b" d"
    pieces = list(decontaminate.words_of(text))
    assert [w for p in pieces for w in p] == [b"ab" * 700_000, b"c", "é".encode() * 800_000, b"d"]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_decontamination"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
