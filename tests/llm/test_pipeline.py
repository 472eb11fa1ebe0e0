"""The corpus pipeline against a plain Python version, stage by stage on what the stage before kept."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SIGNS = [None, "", "?! 42", " \n "]


def documents():
    r = random.Random(5)
    word = {"aa": lambda: "".join(r.choices("abcdefgh", k=r.randrange(4, 8))), "bb": lambda: "".join(r.choices("qrstuvwx", k=r.randrange(4, 8)))}
    rows = []
    for i in range(48):
        lang = "aa" if i % 2 else "bb"
        text = " ".join(word[lang]() for _ in range(60))
        if 4 <= i < 20:
            text = f"shown on page {i} of 99\n{text}\nsame footer as ever"
        rows.append([i, text, lang if i != 30 else None, ("s0", "s0", "s1", None)[i % 4]])
    rows.append([48, rows[21][1], "aa", "s1"])  # an exact copy, two near ones, and a text that is too far
    for i, places in ((49, [30]), (50, [59]), (51, range(0, 60, 9))):
        words = rows[22][1].split(" ")
        for p in places:
            words[p] = word["bb"]()
        rows.append([i, " ".join(words), "bb", "s0"])
    rows += [[52 + i, text, "aa", "s0"] for i, text in enumerate(SIGNS)]
    rows.append([60, "same footer as ever", "aa", "s1"])  # nothing but a line that recurs
    return [(*row, len(row[1] or "")) for row in rows]


def without_footers(rows):
    first = min(r[0] for r in rows if "footer" in r[1])
    out = []
    for doc, text, lang, source, _ in rows:
        lines = [x for x in text.split("\n") if doc == first or "footer" not in x and "shown on page" not in x]
        if lines:
            out.append((doc, "\n".join(lines), lang, source, len("\n".join(lines))))
    return out


def one_of_each_group(rows):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if root[r[0]] == r[0]]


def mixed(rows):
    """Serve the documents one by one by finish time."""
    queues = defaultdict(list)
    for r in rows:
        queues[r[3]].append((int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16), r, len(r[1].split())))
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(n for _, _, n in queues[s]) for s in names}
    target, open_ = {}, set(names)
    while open_:
        share = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full} or {s: share * weight[s] for s in open_}
        open_ -= full or open_
    served = []
    for s in names:
        at = 0
        for turn in range(3):
            for key, r, n in sorted(queues[s], key=lambda q: q[:1]):
                if at < target[s]:
                    served.append(((at + n) / target[s], s is None, s or "", key, r, n))
                at += n
    taken, total = [], 0
    for *_, r, n in sorted(served, key=lambda x: x[:4]):
        total += n
        if total > sum(target.values()) + 1e-6:
            break
        taken.append(r)
    return taken


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept = one_of_each_group(without_footers([r for r in rows if r[1] not in SIGNS]))
    assert {48, 49, 50, 60}.isdisjoint(r[0] for r in kept) and 51 in [r[0] for r in kept]
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter((r[0], r[3], r[2], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in mixed(kept))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, r.lang, tuple(r.ids)) for r in got) == want
    assert max(want.values()) > 1


def test_stages_keep_the_columns_and_take_nothing(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()


def test_empty_and_unlabelled_tables_go_through(spark, tmp_path):
    for name, rows in (("empty", []), ("unlabelled", [(*r[:2], None, *r[3:]) for r in documents()[:6]])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).select("doc_id").collect()} <= {r[0] for r in rows}
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "?!", None, "s", 2)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_rows_are_judged_one_by_one(spark):
    """Rows without an id or with one id do not share a decision, whatever other columns are called."""
    good = documents()[:24]
    odd = [(None, "?! 42", "aa", "s0", 5), (None, good[0][1], "bb", "s0", 9), (1, "?!", "aa", "s1", 2), (2, "??", "aa", "s1", 2), (good[3][0], "%%", "aa", "s1", 2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, gone long, key string, id int, row string, a int"
    docs = spark.createDataFrame([(*r, 1, "k", 2, "r", 3) for r in [*good, *odd, good[5]]], names)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    want = [*good, odd[1], good[5]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:5] for r in got.collect()], key=key) == sorted(want, key=key)


def test_stages_take_documents_without_counts_and_with_any_columns(spark):
    rows = [(i, f"shown on page {i} of 99\nown words {'abcdefghijklmnopqrst'[i]} of text here", "aa", "s", i, "g") for i in range(20)]
    rows += [(None, "same words without an id", "aa", "s", 1, "g")] * 2 + [(40, None, "aa", "s", 1, "g"), (41, " \n", "aa", "s", 1, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone int, id string")
    cleaned = corpus_pipeline.lines(spark, docs, "")
    assert cleaned.columns == docs.columns and cleaned.filter("text like '%page%'").count() == 1
    assert sorted(r.doc_id for r in cleaned.filter("doc_id is not null").collect()) == list(range(20)) and cleaned.filter("doc_id is null").count() == 2
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.mixture):
        assert stage(spark, cleaned, "").columns == docs.columns
    assert corpus_pipeline.near_copies(spark, cleaned, "").filter("doc_id is null").count() == 2
