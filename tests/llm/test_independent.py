"""Second versions in plain Python of what SQL cannot say: fingerprints, token attribution, language of pages."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
from evalspark.llm import language_id, order_minhash, token_counts  # noqa: E402

BYTES = public.path("byte_bpe_50k.json")
WORD = 2**64 - 1


# --- op5 ----------------------------------------------------------------------------


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


def kmer_hash(codes):
    """The hash of one k-mer from those of its halves."""
    k = len(codes)
    if k == 1:
        return codes[0] + 1
    half = k // 2
    both = (kmer_hash(codes[:half]) * (0x9E3779B97F4A7C15 + 2 * k) + kmer_hash(codes[half : 2 * half])) & WORD
    return (both * 0xD1342543DE82EF95 + codes[-1] + 1) & WORD if k % 2 else both


def plain_fingerprint(text, k=6, sketches=64, picks=2):
    codes = [ord(c) for c in text]
    if not codes:
        return ""
    kmers = [tuple(codes[i : i + k]) for i in range(len(codes) - k + 1)] or [tuple(codes)]
    seen, values = {}, []
    for kmer in kmers:  # occurrences are told apart by the k-mers themselves
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        h = mixed(kmer_hash(kmer))
        values.append((mixed((h + nth * 0xD1342543DE82EF95) & WORD) if nth else h) >> 32)
    factors = (np.random.default_rng(6).integers(0, 2**31, sketches, np.uint32) * np.uint32(2) + np.uint32(1)).tolist()
    out = ""
    for factor in factors:
        chosen = sorted(sorted(range(len(values)), key=lambda i: (values[i] * factor % 2**32, i))[:picks])
        tuple_hash = 0
        for i in chosen:
            tuple_hash = mixed((tuple_hash * 0x9E3779B97F4A7C15 + values[i] + 1) & WORD)
        out += f"{tuple_hash >> 48:04x}"
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) / 4)


def test_fingerprints_edits_and_likeness_equal_plain_python(spark):
    r = random.Random(11)
    base = "".join(r.choice("abcdé日 \n") for _ in range(400))
    some = ["", None, "a", "abcde", "abcdef", "aaaaaaaaaaaaaaaa", base, base[:350], base[:200] + "xyz" + base[200:], "".join(r.choice("ab") for _ in range(9000)), "😀" * 20, "é" * 7]
    rows = [(r.choice([None, 1, 1, 2, 3, 5, 8, 13, -4]), t) for t in some * 3]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, head int")
    got = order_minhash.edit_probe(docs).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), (x[1] or "").encode()))
    want = []
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        one, two, three = plain_fingerprint(text), plain_fingerprint(changed), plain_fingerprint(following)
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), one, two, plain_likeness(one, two), plain_likeness(one, three)))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_few_edits_stay_near_and_moves_do_not(spark):
    r = random.Random(13)
    text = "".join(r.choice("abcdefghij ") for _ in range(3000))
    near, shuffled = text[:1500] + "some words put in" + text[1500:], "".join(r.sample(text, len(text)))
    likeness = lambda other: order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(other))
    assert likeness(text) == 1 and likeness(near) > 0.8 and likeness(text[1500:] + text[:1500]) < 0.8 and likeness(shuffled) < 0.1


# --- op1 ----------------------------------------------------------------------------


def attributed(offsets, a, b, rule):
    """n_tokens, token_share and n_crossing of a section, token by token."""
    b = max(a, b)
    n = share = crossing = 0
    for x, y in offsets:
        n += a <= x < b if rule == "first" else a <= y - 1 < b
        inside = max(0, min(b, y) - max(a, x))
        share += inside / (y - x) if y > x else 0
        crossing += 0 < inside < y - x
    return n, round(share, 6), crossing


def odd_texts():
    r = random.Random(17)
    words = ["hello", "wonderful", "日本", "naïve", "😀", "  ", "x1", "…", "it's"]
    lines = lambda: "".join(r.choice(words) + r.choice([" ", "\n", "", "\n\n", "\r\n"]) for _ in range(r.randrange(60)))
    return [None, "", "\n", "one", "one\n", "\n\n x", *[lines() for _ in range(30)], "long line of words " * 900]


@pytest.mark.parametrize("rule", ["first", "last"])
def test_tokens_of_every_line_equal_plain_python(spark, rule):
    library = tokenizers.Tokenizer.from_file(BYTES)
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = {}
    for x in token_counts.section_tokens(docs, BYTES, ["doc_id"], rule=rule).collect():
        got.setdefault(x.doc_id, []).append((int(x.section), x.start, x.stop, x.n_tokens, x.token_share, x.n_crossing, x.doc_tokens))
    for i, text in enumerate(texts):
        text = text or ""
        offsets = library.encode(text, add_special_tokens=False).offsets
        starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        if len(starts) > 1 and starts[-1] == len(text):
            starts.pop()
        want = [(n, a, b, *attributed(offsets, a, b, rule), len(offsets)) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)]))]
        found = sorted(got[i])
        assert [x[:4] + x[5:] for x in found] == [x[:4] + x[5:] for x in want]
        assert [x[4] for x in found] == pytest.approx([x[4] for x in want], abs=2e-6)


@pytest.mark.parametrize("rule", ["first", "last"])
def test_tokens_of_given_sections_equal_plain_python(spark, rule):
    library = tokenizers.Tokenizer.from_file(BYTES)
    r = random.Random(19)
    rows = []
    for i, text in enumerate(odd_texts()):
        size = len(text or "")
        places = [(f"p{k}", r.randrange(size + 1), r.randrange(size + 9)) for k in range(4)] + [(None, None, 3), ("r", 5, 2), ("n", -4, None)]
        rows.append((i, text, r.choice([places, places, None, [], [*places[:1], None]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, places array<struct<section string, start long, stop long>>")
    got = sorted(((x.doc_id, x.section or "", x.start, x.stop, x.n_tokens, x.token_share, x.n_crossing) for x in token_counts.section_tokens(docs, BYTES, ["doc_id"], sections="places", rule=rule).collect()))
    want = []
    for i, text, places in rows:
        text = text or ""
        offsets = library.encode(text, add_special_tokens=False).offsets
        for section, a, b in [p for p in places or [] if p]:
            a, b = (min(max(v or 0, 0), len(text)) for v in (a, b))
            want.append((i, section or "", a, b, *attributed(offsets, a, b, rule)))
    want.sort()
    assert [x[:5] + x[6:] for x in got] == [x[:5] + x[6:] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], abs=2e-6)


# --- language of pages ----------------------------------------------------------------


def test_address_and_markup_are_read_as_written(spark):
    pages = [
        ("http://www.News.example.co.de:8080/a?b#c", '<!DOCTYPE html><HTML class="x" lang="DE-at"><p>ein &amp; aus<script>var t = "</p>";</script></p>'),
        ("https://user:secret@host.fr/x", "<html lang=fr><!-- <p>nicht</p> --><style>p{}</style>oui<br>non</html>"),
        ("//plain.es", "<html><p lang='en'>si"), ("ftp://only", ""), ("no address", None), (None, "text only"), ("http:///path", "<html data-lang='xx'>"),
    ]
    rows = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    got = {r.id: r for r in language_id.page_evidence(rows).collect()}
    assert [(got[i].host, got[i].domain, got[i].suffix) for i in range(7)] == [
        ("www.news.example.co.de", "co.de", "de"), ("host.fr", "host.fr", "fr"), ("plain.es", "plain.es", "es"), ("only", "only", "only"),
        (None, None, None), (None, None, None), (None, None, None)]
    assert [got[i].declared for i in range(7)] == ["de", "fr", None, None, None, None, None]
    assert [" ".join((got[i].text or "").split()) for i in range(7)] == ["ein aus", "oui non", "si", "", "", "text only", ""]


def test_posterior_of_pages_equals_plain_python(spark):
    """Declared language, host, parent domain and suffix, each smoothed towards the next, without the page itself."""
    own = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwyx", "lorex", "kkjh"], "cc": ["quorum", "dolex", "ips"]}
    r = random.Random(23)
    model = language_id.train(spark.createDataFrame([(j, " ".join(r.choices(own[k], k=4)), k) for j, k in enumerate(list(own) * 15)], "id long, text string, label string"))
    hosts = ["a.x.de", "b.x.de", "y.de", "a.x.fr", "z.org", None]
    pages = []
    for j in range(60):
        k, host = r.choice(list(own)), r.choice(hosts)
        tag = r.choice(["", f' lang="{k}"', ' lang="zz"', ' lang="aa-XX"'])
        words = " ".join(r.choices(own[k], k=r.randrange(3)) + r.choices(own[r.choice(list(own))], k=1)) if j % 11 else "12 !"
        pages.append((j, f"http://{host}/p{j}" if host else "none", f"<html{tag}><p>{words}</p>"))
    found = {x.id: x for x in language_id.identify(language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    names, n = model.languages, len(model.languages)
    texts = [" " + re.sub("<[^>]*>", " ", h) for _, _, h in pages]
    scores = [model.score(t) for t in texts]
    logs = [s[0] / 3 for s in scores]
    weighs = [s[1] > 0 and s[2] for s in scores]
    shares = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() * w for x, w in zip(logs, weighs)]
    host = [re.match("http://([^/]+)", u).group(1) if u.startswith("http") else None for _, u, _ in pages]
    keys = [[h and h.split(".")[-1], h and ".".join(h.split(".")[-2:]), h] for h in host]
    said = [(re.search('lang="([a-z]+)', h) or [None, None])[1] for _, _, h in pages]
    kind = [None if s is None else s if s in names else "other" for s in said]
    base = (sum(shares) + 1) / (sum(weighs) + n)
    for j in range(len(pages)):
        prior = base
        for level in range(3):
            if keys[j][level] is not None and any(weighs[k] and keys[k][level] == keys[j][level] for k in range(len(pages))):
                others = sum((shares[k] for k in range(len(pages)) if keys[k][level] == keys[j][level] and k != j), np.zeros(n))
                prior = (others + 5 * prior) / (others.sum() + 5)
        fused = logs[j] + np.log(prior)
        if kind[j] is not None:
            counts = {c: sum((shares[k] for k in range(len(pages)) if kind[k] == c), np.zeros(n)) for c in [*names, "other"]}
            fused = fused + np.log((counts[kind[j]] + 0.5) / (sum(counts.values()) + 0.5 * (n + 1)))
        p = np.exp(fused - fused.max()) / np.exp(fused - fused.max()).sum()
        assert abs(found[j].posterior - p.max()) < 2e-6, j
        assert found[j].language == names[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-9
        assert found[j].kept == (weighs[j] and round(p.max(), 6) >= 0.5)
