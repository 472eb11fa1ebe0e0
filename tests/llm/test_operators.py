"""The operators against plain Python, on texts with every odd case, and on empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
from evalspark.llm import bpe, embedding_dedup, language_id, line_dedup, minhash, mixing, order_minhash, substring_dedup, token_counts, token_files  # noqa: E402

BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row string"


def texts():
    r = random.Random(1)
    words = ["the", "of", "it's", "naïve", "élan", "x<|endoftext|>y", "a b", "日本", "!!'s", "12ab", "…", " ", "ŉ", "İ", "é", "don't,", "'ré"]
    some = ["", None, " ", "\n\n", "one", "  lead\n\n\n tail  ", "😀 　 z", "a" * 5000, "w " * 300, "<|endoftext|>", "\t\ta\r\nb\x0b\x0cc\x00d"]
    some += [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(20)]
    base = [f"w{r.randrange(40)}" for _ in range(150)]
    some += [" ".join(base), " ".join(base), " ".join(base[:70] + ["new"] + base[70:]), "lead " + " ".join(base[40:110])]
    return some


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[-1], rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_encoding_equals_the_library(docs):
    library = tokenizers.Tokenizer.from_file(BYTES)
    for r in bpe.encode_documents(docs, BYTES, ["doc_id", "text", "h"], outputs=("n_tokens", "ids", "ids_sha256", "decoded")).toDF("doc_id", "text", "h", "n", "ids", "sha", "decoded").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n, list(r.ids), r.decoded) == (len(ids), ids, r.text or "")
        assert r.sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_latin_characters_and_long_runs_equal_the_library():
    library, model = tokenizers.Tokenizer.from_file(BYTES), token_counts.span_encoder(BYTES)
    odd = [form.replace("?", chr(c)) for c in range(0x250) for form in ("a?b", " ? x", "??1", "'?'s", "  ?\n?", "!?!")]
    odd += [" " * 30_000 + "x", "!" * 30_000, "\n" * 20_001, "日" * 500, "x<|endoftext|>" * 3]
    for text, ids in zip(odd, model.encode(odd)):
        want = library.encode(text, add_special_tokens=False)
        assert ids == np.array(want.ids, "<u4").tobytes() and model.decode(ids) == text
        assert list(zip(*[x.tolist() for x in model.spans(text)])) == want.offsets


def test_words_of_many_texts_equal_the_library():
    library, model = tokenizers.Tokenizer.from_file(WORDS), token_files.word_encoder(WORDS)
    odd = [form.replace("?", chr(c)) for c in range(0x250) for form in ("a?b", " ? x", "??1", "'?'s", "  ?\n?", "!?!")]
    odd += ["", " ", "a\0b", "<|endoftext|> x", "日本 語 x", "e\u0301 é", "A" * 5000, "'S 'RE don't", "\x85a\xa0b\x1cc", "x" * 30_000 + " " + "!" * 20_000]
    for size in (5, len(odd)):  # plain words alone, and together with others
        got = [ids for at in range(0, len(odd), size) for ids in model.encode(odd[at : at + size])]
        assert got == [np.array(library.encode(t, add_special_tokens=False).ids, model.dtype).tobytes() for t in odd]
    assert model.encode([]) == [] and model.encode(["", " "]) == [b"", b""]


def test_cuts_keep_the_ids():
    library, model = tokenizers.Tokenizer.from_file(BYTES), bpe.encoder(BYTES)
    text = " ".join(t or "" for t in texts() if "<|" not in (t or ""))
    at = [0, *model.cuts(text), len(text)]
    parts = [text[a:b] for a, b in zip(at, at[1:])]
    assert len(parts) > 1000 and [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_sections_add_up_and_follow_their_rule(docs):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = token_counts.section_tokens(docs.dropDuplicates(["doc_id"]), BYTES, ["doc_id"]).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert all(total[r.doc_id] == r.doc_tokens == len(library.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)
    spans = library.encode("hello wonderful world", add_special_tokens=False).offsets
    s, e = (np.array(x) for x in zip(*spans))
    for rule in token_counts.RULES:
        for a in range(0, 20):
            for b in range(a, 21):
                got = token_counts.attribute(s, e, np.array([a]), np.array([b]), rule)
                inside = [(x, y) for x, y in spans if (a <= x < b if rule == "first" else a <= y - 1 < b)]
                share = sum(max(0, min(b, y) - max(a, x)) / (y - x) for x, y in spans)
                assert got[0][0] == len(inside) and abs(got[1][0] - share) < 1e-9


def test_token_files_round_trip(docs):
    library = tokenizers.Tokenizer.from_file(WORDS)
    once = docs.dropDuplicates(["doc_id"])
    index = token_files.write_token_files(once, WORDS, end_id=2, length=16, rows=3, files=3)
    found, at = {r.doc_id: r for r in token_files.read_documents(index).collect()}, 0
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ids, mask = token_files.sequence(token_files.open_file(index.orderBy("block").first().path), 0)
    assert len(ids) == len(mask) == 16


def test_repeats_equal_brute_force(docs):
    rows = [(i, (t or "").encode().split()) for i, t in enumerate(texts())]
    first = {}
    for i, w in rows:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = {}
    for i, w in rows:
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        want[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    for rounds in (0, 3, 6, 9):
        got = substring_dedup.drop_repeats(docs, rounds=rounds).collect()
        assert all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got) and len(got) == len(rows) + 2
    assert any(n for _, n, _ in want.values())


def test_near_duplicates_equal_brute_force(docs):
    sets = {i: minhash._shingles(minhash.lowered(t or ""), 2) for i, t in enumerate(texts())}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.near_duplicates(docs, width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert len(got) == len(sets) + 2


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 8))
    rows = [v.tolist() for v in np.concatenate([base, base[:10], base[:15] + 0.05 * r.standard_normal((15, 8))])]
    rows += [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] * 8]
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    good = np.array(rows[:65])
    unit = good / np.linalg.norm(good, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(65, dtype=bool)
    assert [got[i].n_links for i in range(65)] == links.sum(axis=1).tolist()
    assert all(got[i].component_id == got[j].component_id for i, j in np.argwhere(links))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(65, 71))


def test_vectors_of_several_lengths_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for width in (8, 3, 12, 8, 5):
        base = r.standard_normal((12, width))
        rows += [v.tolist() for v in np.concatenate([base, base[:3], base[:6] + 0.02 * r.standard_normal((6, width))])]
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").coalesce(1), recall=0.99999).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    want = {a: sum(len(x) == len(y) and a != b and x @ y >= 0.95 for b, y in enumerate(unit)) for a, x in enumerate(unit)}
    assert got == want and all(any(want[k] for k in range(21 * g, 21 * g + 21)) for g in range(5))


@pytest.mark.parametrize("mean", [0.0, 1.0, 3.0])
def test_links_of_vectors_with_a_common_direction(spark, mean):
    r = np.random.default_rng(12)
    base = r.standard_normal((1500, 48)) + mean
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    turned = r.standard_normal((400, 48))
    turned -= (turned * unit[:400]).sum(axis=1, keepdims=True) * unit[:400]
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    near = 0.952 * unit[:400] + np.sqrt(1 - 0.952**2) * turned  # pairs just above the threshold
    rows = np.concatenate([unit, near])
    got = {x.vec_id: x.n_links for x in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    want = (rows @ rows.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    centres = {48: unit.mean(axis=0)}
    bits, tables, _ = embedding_dedup.plan_tables(50_000, list(rows[:1000]), centres)
    assert tables <= 64 and (mean < 3 or bits == 0)  # hardly anything tells vectors of one direction apart: one bucket, in blocks


def test_fingerprints_and_edits(docs):
    order = sorted(enumerate(texts()), reverse=True)
    got = {r.doc_id: r for r in order_minhash.edit_probe(docs.dropDuplicates(["doc_id"])).collect()}
    for k, (i, t) in enumerate(order):
        changed = order_minhash.edited(t or "", order[(k + 1) % len(order)][1] or "")
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (order_minhash.fingerprint(t or ""), order_minhash.fingerprint(changed))


def test_recurring_lines_go_but_for_the_first(spark):
    rows = [(i, f"Own line of document {'abcdefghijklmnopqrst'[i]} alone\nPage {i} of 20 printed here\nsame footer") for i in range(20)]
    rows += [(20, None), (21, ""), (22, "single clean text"), (22, "single clean text")]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[20] is None and got[21] == "" and got[22] == "single clean text"
    assert all("Page" not in got[i] and "footer" not in got[i] for i in range(1, 20))


def test_distinct_short_and_numeric_lines_stay(spark):
    w = [f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"]
    own = lambda i: [
        f"It was a {w[i]}", f"It was a {w[i]} {w[-i]}", f"{100 + i}", f"{i}.5 {i * 7} {i * 9}", f"A{i} B{i}", f"Total {i} {i * 3} {i * 5} {w[i]}",
        f"| {i} | {i + 5} |", f"see the list 1{i} 2{i} 3{i} {w[i]}",
    ]
    shared = lambda i: ["It was a pity", f"Page {i} of 20", f"Copyright {1990 + i} by the Example Press of {w[i]} and all its heirs", "----"]
    rows = [(i, "\n".join(own(i) + shared(i))) for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(own(i) + (shared(i) if i == 0 else [])) for i in range(20)}


def test_mix_keeps_to_targets(docs):
    got = mixing.mix(docs).collect()
    assert all(r.taken == r.size * r.copies and r.copies <= 3 and r.target <= 3 * r.source_size for r in got)
    assert sum(r.taken for r in got) <= sum(r.size for r in got)
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got) and mixing.mixed_rows(docs).columns == docs.columns


def test_language_is_found_and_signs_are_rejected(spark):
    own = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwyx qqvz kkjh pqrs "}
    rows = [(i, own[k] * (1 + i % 3), k, f"h{i % 5}") for i in range(40) for k in own]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(language_id.labelled_documents(labelled))
    odd = labelled.limit(0).union(spark.createDataFrame([(1, "lorem ipsum", None, None), (2, None, "aa", "h1"), (3, "?! 42", "bb", "h2"), (4, "kkjh zwyx", "aa", "h0")], labelled.schema))
    got = {r.id: r for r in language_id.identify(language_id.document_evidence(odd), model).collect()}
    assert (got[1].language, got[1].kept) == ("aa", True) and got[4].text_language == "bb"
    assert not got[2].kept and not got[3].kept


def test_no_label_rejects_nothing_and_names_no_language(spark, docs, empty):
    for some in (empty, docs.withColumn("lang", F.lit(None).cast("string"))):
        model = language_id.train(language_id.labelled_documents(some))
        got = language_id.identify(language_id.document_evidence(some), model).collect()
        assert len(got) == some.count() and all((r.language, r.posterior, r.text_language, r.kept) == (None, None, None, r.n_triples > 0) for r in got)
    known = language_id.train(language_id.labelled_documents(docs))
    assert language_id.identify(language_id.document_evidence(empty), known).count() == 0


def test_any_number_of_labels_and_their_spellings(spark):
    r = random.Random(4)
    own = {f"l{k}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for k in range(150)}
    rows = [(10 * k + i, " ".join(r.choices(words, k=30)), (name, name.upper(), f" {name} ")[i % 3], "s") for k, (name, words) in enumerate(own.items()) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(language_id.labelled_documents(docs))
    assert model.languages == sorted(own)
    got = {x.id: x for x in language_id.identify(language_id.document_evidence(docs), model).collect()}
    assert all((got[i].language, got[i].text_language, got[i].kept) == (f"l{i // 10}", f"l{i // 10}", True) for i, *_ in rows)
    codes = spark.createDataFrame([("en",), ("EN",), ("en-US",), (" en_GB.UTF-8",), ("??",), (None,), ("Lang_07",)], "x string")
    assert [c.x for c in codes.select(language_id.language_code(F.col("x")).alias("x")).collect()] == ["en"] * 4 + [None, None, "lang_07"]


def test_posterior_equals_plain_python(spark):
    own = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwyx", "lorex", "kkjh"]}
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(own[k], k=1 + i % 3)), (k, None, "zz")[i % 5 % 3], f"h{i % 3}" if i % 7 else None) for i in range(30) for k in own]
    docs = spark.createDataFrame([(j, *row[1:]) for j, row in enumerate(rows)], "doc_id long, text string, lang string, source string")
    model = language_id.train(language_id.labelled_documents(docs))
    names = model.languages
    logs = [model.score(t)[0] / 3 for _, t, *_ in rows]
    shares = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    base = (sum(shares) + 1) / (len(rows) + len(names))
    got = {x.id: x for x in language_id.identify(language_id.document_evidence(docs), model).collect()}
    for j, (_, _, lang, host) in enumerate(rows):
        others = sum((shares[k] for k in range(len(rows)) if host and rows[k][3] == host and k != j), np.zeros(len(names)))
        fused = logs[j] + np.log((others + 5 * base) / (others.sum() + 5) if host else base)
        if lang:
            said = {c: sum((s for s, row in zip(shares, rows) if row[2] == c), np.zeros(len(names))) + 0.5 for c in names}
            fused += np.log(said[lang] / sum(said.values(), np.full(len(names), 0.5)))
        p = np.exp(fused - fused.max()) / np.exp(fused - fused.max()).sum()
        assert got[j].language == names[p.argmax()] and abs(got[j].posterior - p.max()) < 2e-6


def test_texts_that_fit_no_label_are_rejected(spark):
    r = random.Random(8)
    parts = {"aa": "the and ing of tion er en", "bb": "der ein sch ung ich aus lich", "cc": "que les eau ent oir ais", "dd": "los una cion ado ella mos", "ee": "kko yyt suo nnä äiv lle uus"}
    words = {k: ["".join(r.choices(v.split(), k=r.randrange(1, 4))) for _ in range(150)] for k, v in parts.items()}
    text = lambda k, n: " ".join(r.choices(words[k], k=n))
    junk = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 10))) for _ in range(n))
    clean = [(text(k, n), k) for k in ("aa", "bb", "cc", "dd") for n in [1, 3, 8, *[60] * 10, 400]]
    clean += [(text("aa", 100) + " " + text("bb", 100), "aa"), (text("cc", 5), "dd"), (text("dd", 60) + " " + junk(15), None)]
    other = [(text("ee", n), k) for n in (20, 60, 400) for k in (None, "ee", "aa")] + [(junk(n), k) for n in (20, 60, 400) for k in (None, "bb")]
    frame = lambda rows: spark.createDataFrame([(i, t, k, "s") for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    dirty = [(junk(60), "aa") for _ in range(2)]
    model = language_id.train(language_id.labelled_documents(frame([*((text(k, 80), k) for k in ("aa", "bb", "cc", "dd") for _ in range(40)), *dirty])))
    found = sorted(language_id.identify(language_id.document_evidence(frame([*clean, *other])), model).collect())
    assert [x.id for x in found if not x.kept] == list(range(len(clean), len(clean) + len(other)))


def test_empty_tables(spark, empty):
    assert bpe.encode_documents(empty, BYTES, ["doc_id"]).count() == 0
    assert token_counts.section_tokens(empty, BYTES, ["doc_id"]).count() == 0
    assert token_files.read_documents(token_files.write_token_files(empty, WORDS, end_id=2)).count() == 0
    assert substring_dedup.drop_repeats(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert order_minhash.edit_probe(empty).count() == 0
    assert line_dedup.drop_recurring_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert embedding_dedup.near_vectors(empty.select("doc_id", F.array(F.lit(1.0)).alias("e")), "doc_id", "e").count() == 0


def words_of_line(raw):
    import re

    return ["<*>" if re.search(r"\d", w) else w for w in re.sub(r"\s+", " ", raw).strip(" ").split(" ") if w]


def brute_lines(rows, least=10, depth=3, similarity=0.75):
    """Every line with its templates, the narrowest that enough texts have, and what is left of the texts."""
    lines = [(i, t, p, words_of_line(x)) for i, t in dict.fromkeys(rows) if t is not None for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    at = Counter()
    for _, _, _, w in lines:
        at.update((len(w), tuple(w[:depth]), p, x) for p, x in enumerate(w) if p >= depth and x != "<*>")
    # repeated rows count each time where words are counted
    for (i, t), n in Counter(rows).items():
        for x in (t or "").split("\n") if t is not None else []:
            w = words_of_line(x)
            at.update({(len(w), tuple(w[:depth]), p, y): n - 1 for p, y in enumerate(w) if p >= depth and y != "<*>"})
    letter = lambda w: any(c.isalpha() for c in w)
    templates, texts = {}, {}
    for i, t, p, w in lines:
        leaf, k = (len(w), tuple(w[:depth])), sum(x != "<*>" for x in w[depth:])
        limit = least
        while limit <= max([at[(*leaf, q, x)] for q, x in enumerate(w) if q >= depth and x != "<*>"], default=least):
            shape = tuple(x if q < depth or x != "<*>" and at[(*leaf, q, x)] >= limit else "<*>" for q, x in enumerate(w))
            kept = sum(x != "<*>" for x in shape[depth:])
            if kept >= similarity * k and sum(x != "<*>" and letter(x) for x in shape) >= sum(x == "<*>" for x in shape):
                templates.setdefault((i, t, p), []).append(shape)
                texts.setdefault(shape, set()).add(t)
            limit *= 2
    chosen = {place: next((s for s in shapes if len(texts[s]) >= least), None) for place, shapes in templates.items()}
    first = {}
    for (i, _, _), s in chosen.items():
        if s is not None and i is not None:
            first[s] = min(first.get(s, i), i)
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if chosen.get((i, t, p)) is None or i == first.get(chosen[i, t, p]))) for i, t in rows]


@pytest.mark.parametrize("n_templates", [1, 2, 3])
def test_equally_frequent_templates_of_a_leaf_all_go(spark, n_templates):
    kinds = ["last edited on {} by hand", "first written in {} for us", "never seen before {} at all"][:n_templates]
    own = [f"{a}{b}ing" for a in "bcdfgh" for b in "aeiouy"]
    rows = [(i, f"this page was {kinds[i % n_templates].format(own[i])}") for i in range(36)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i < n_templates else "" for i, t in rows}


def test_line_templates_equal_brute_force(spark):
    r = random.Random(9)
    days = ["Monday", "Tuesday", "Friday"]
    some = ["the {d} edition of our small paper came out late {n}", "the {d} edition of our small paper came out {w}", "see page {n} of {n}", "{n} {n} {n}",
            "the {w} edition of {w} small {w} came {w} late {n}", "same old footer", "read more about this and that on {d} or on {d} with {w}"]
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    rows = []
    for i in range(120):
        lines = [r.choice(some) for _ in range(r.randrange(6))] + r.choice([[], [""], ["  "], [long], [long + " {w}"]])
        fill = lambda x: x.replace("{d}", r.choice(days)).replace("{n}", str(r.randrange(99))).replace("{w}", "".join(r.choices("abcdef", k=3)))
        rows.append((i if i % 17 else None, "\n".join(fill(x) for x in lines)))
    rows += [(500, None), (501, ""), rows[5], rows[5], (rows[7][0], rows[7][1])]
    docs = spark.createDataFrame([(i, t, "d", "c", 1) for i, t in rows], "doc_id long, text string, doc string, copy string, leaf int")
    got = line_dedup.drop_recurring_lines(docs)
    assert got.columns == docs.columns
    want = brute_lines(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted([(x.doc_id, x.text) for x in got.collect()], key=key) == sorted(want, key=key)
    assert sum(len(t or "") for _, t in want) < 0.6 * sum(len(t or "") for _, t in rows)
