"""Small cases of every text operator: nulls, empty and long texts, ties, repeats,
empty tables, clashing names, and brute-force versions of what SQL cannot say."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herdlens.llm import chat, decontaminate, fingerprints, line_dedup, near_dedup, pieces, substring_dedup
from herdlens.llm import token_files, toxicity, url_filters

DOCS = "doc_id bigint, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", " a", "a  b ", "x\ny\n\nz", "▁a ▁▁ b", "<s> <0x41> <unk>", "日本語 テスト é", "😀 👍🏽", "\t\r\n 　c",
    "http://a.b/c?d=e", "def f(x):\n        return x", "a" * 3000, "İstanbul ǅ ß ÀÉ don't we'll 1st 2nd", "<|endoftext|> a<|x|>",
]


def prose(seed: int, n: int) -> list:
    """``n`` words of an invented language."""
    rng = random.Random(seed)
    return ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "e", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- SentencePiece ----------------------------------------------------------
def test_pieces_equal_the_library(spark):
    texts = [*ODD, " ".join(prose(1, 5000))]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = table(spark, list(enumerate(texts)) + [(3, "a")])
    ids = pieces.encode_texts(df, PIECES, ["doc_id"])
    rows = pieces.decode_ids(ids, PIECES, ["doc_id", "ids"]).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        expected = library.encode(texts[r.doc_id] or "")
        assert r.ids == expected and r.decoded == library.decode(expected)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e.▁\n,éß日 <>0x"), max_size=40))
def test_agenda_equals_the_library(text):
    model = pieces.piece_model(PIECES)
    assert np.frombuffer(model.encode([text])[0], "<i4").tolist() == model.library.encode(text)


def test_pieces_with_clashing_columns_and_long_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["w1" * 500_000, "a b\n" * 50_000 + " ", None]  # a megabyte without a space
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in enumerate(texts)], f"{DOCS}, ids int, decoded string, _text string")
    rows = pieces.code_and_decode(df, PIECES, df.columns).collect()
    assert len(rows) == 3 and rows[0]._text == "y"
    for r in rows:
        expected = library.encode(texts[r.doc_id] or "")
        assert r.ids == expected and r.decoded == library.decode(expected)


def test_pieces_of_an_empty_table(spark):
    ids = pieces.encode_texts(table(spark, []), PIECES, ["doc_id"])
    assert pieces.decode_ids(ids, PIECES, ["doc_id"]).collect() == []


# --- token files ------------------------------------------------------------
def test_token_files_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(prose(i, 30))) for i in range(40)]
    rows += [(None, "no id"), (7, "same id"), (50, None), (50, None)]
    rng.shuffle(rows)
    folder = token_files.write_token_files(table(spark, rows).repartition(5), WORDS)
    read = token_files.read_token_files(spark, folder).orderBy("start").collect()
    library = Tokenizer.from_file(WORDS)
    expected = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == expected
    assert [r.start for r in read] == np.cumsum([0, *[r.n_tokens for r in read]])[:-1].tolist()
    ids = [r.doc_id for r in read]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_token_files_cut_words_as_the_library_does():
    texts = [
        "", " ", "\n", "Don't, we'll; they'd've 'S 't''s rock'n'roll", "a1b22c333 4.5e-6 x²", "ÀÉÎ Ößÿ ×÷ Þorn ñ\n\nñ", "<|endoftext|> a<|x",
        "  two  spaces ", "日本語 текст ŁÓDŹ İstanbul ﬁ", "e\u0301 \xa0 \xad \x00 \t tab\r\n", "x" * 5000, "(well-known),[sic]!? " * 50,
    ]
    letters = "abZ'stÉß×9.<|日\u0301 "
    texts += ["".join(letters[(i * 31 + k * k * (i + 7)) % len(letters)] for k in range(40)) for i in range(200)]
    encoder, library = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode(pa.array(texts), [1])
        expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_token_files_handle_plain_chunks_as_words():
    encoder = token_files.WordEncoder(WORDS)
    encoder.encode(pa.array(["(one), one; 'one' one2 ONE!"]), [1])
    assert not encoder.chunks.kept  # no step in Python for a chunk, only for a word
    assert {"one", "2", "),"} <= set(encoder.words.kept)


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write_token_files(table(spark, []), WORDS)
    assert token_files.read_token_files(spark, folder).collect() == []


# --- decontamination --------------------------------------------------------
def brute_hits(docs, items, size=10):
    windows = []
    for item, text in items:
        w = decontaminate.words_of((text or "").encode())
        if w:
            windows += [(str(item) if item is not None else "null", w[b : b + size]) for b in range(max(1, len(w) - size + 1))]
    out = []
    for doc, text in docs:
        w = decontaminate.words_of((text or "").encode())
        hit, found = set(), set()
        for item, win in windows:
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def leak_cases():
    a, b = prose(11, 25), prose(12, 14)
    items = [(1, " ".join(a)), (2, " ".join(b).upper()), (3, "Short one"), (4, ""), (5, None), (None, "kalo!!"), (2, "other text of the same id")]
    docs = [
        (1, None), (2, ""), (3, "..."), (4, " ".join(prose(20, 30) + a[3:15] + prose(21, 10))), (5, " ".join(a + a)),
        (6, " ".join(b)), (7, "a short, ONE is here: short one"), (8, " ".join(a[:9])), (9, "kalo kalo"), (9, "kalo kalo"),
        (None, " ".join(b[:10]) + "é"), (10, "other text of the same id twice"), (11, " ".join(prose(22, 3000) + b + prose(23, 3000))),
    ]
    return docs, items


def test_contamination_equals_brute_force(spark):
    docs, items = leak_cases()
    found = decontaminate.contamination(table(spark, docs).repartition(3), table(spark, items, "item_id bigint, text string"))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()], key=str) == brute_hits(docs, items)


def test_proximity_matches(spark):
    words = ["zeta", "kalo", "mi", "mi", "mi", "mi", "mi", "mi", "mi", "yota"]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:5], "extra", *words[5:]])), (3, " ".join(words[:9]))]
    texts = table(spark, [*docs, *[(9, "mi " * 40)]])
    index, windows = decontaminate.benchmark_index(texts, table(spark, [(1, " ".join(words))], "item_id bigint, text string"))
    ids = {r.doc: r.doc_id for r in index.collect()}
    exact = decontaminate.matches(index, windows)
    assert {(ids[r.doc], r.exact) for r in exact.collect()} == {(1, True)}
    near = decontaminate.matches(index, windows, slop=2)
    assert {(ids[r.doc], r.exact) for r in near.collect()} >= {(1, True), (2, False)}


def test_leaking_rows_go_and_columns_stay(spark):
    docs, items = leak_cases()
    rows = [(i, t, "x", 1) for i, t in docs]
    df = table(spark, rows, "doc_id bigint, text string, digest string, n_hit int")
    kept = decontaminate.without_leaks(df, table(spark, items, "item_id bigint, text string"))
    clean = [(d, n) for d, n, hit, _ in brute_hits(docs, items) if not hit]
    assert kept.columns == df.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([d for d, _ in clean], key=str)
    none = table(spark, [], "item_id bigint, text string")
    assert decontaminate.without_leaks(df, none).count() == len(rows)
    assert decontaminate.contamination(table(spark, []), none).collect() == []


# --- line dedup -------------------------------------------------------------
def brute_lines(docs, size=3):
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(f"{'null' if d[0] is None else d[0]}\n{d[1]}".encode()).hexdigest()))
    seen, out = {}, {}
    for doc in order:
        if doc[1] is None:
            out[doc] = None
            continue
        lines, gone = doc[1].split("\n"), set()
        for i in range(len(lines) - size + 1):
            if tuple(lines[i : i + size]) in seen:
                gone.update(range(i, i + size))
            seen.setdefault(tuple(lines[i : i + size]), (doc, i))
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return Counter((d[0], out[d]) for d in docs)


def line_cases():
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    long = "\n".join(f"line {i % 700}" for i in range(3000))
    return docs + [(None, "a\nb\nc\nd"), (61, None), (62, ""), (63, long), (64, long), (64, long), (5, "b\nb\nb\nb\nb")]


def test_lines_equal_brute_force(spark):
    docs = line_cases()
    rows = [(i, t, "kept", 7) for i, t in docs]
    df = table(spark, rows, "doc_id bigint, text string, digest string, starts int").repartition(4)
    kept = line_dedup.without_repeated_lines(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_lines(docs) and {r.digest for r in got} == {"kept"}
    runs = line_dedup.repeated_runs(df).collect()
    assert all(r.n_lines >= 3 for r in runs)
    assert line_dedup.without_repeated_lines(table(spark, [])).collect() == []


# --- near duplicates --------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=24), st.lists(st.sampled_from("abcd"), max_size=24), st.integers(0, 24))
def test_banded_alignment(a, b, most):
    exact = edits(a, b)
    assert near_dedup.edits_within(a, b, most) == (exact if exact <= most else None)


def near_cases():
    rng = random.Random(9)
    docs = [(i, " ".join(prose(i, 120))) for i in range(30)]
    for i in range(30, 60):  # copies with a few words replaced, inserted or deleted
        words = prose(i % 10, 120)
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 2)
        docs.append((i, " ".join(words)))
    passage = prose(99, 40)
    docs += [(60 + i, " ".join(passage + prose(200 + i, 60))) for i in range(90)]  # share a passage, no duplicates
    docs += [(200, None), (201, ""), (202, "   "), (203, "two words"), (204, "Two  words"), (205, " ".join(prose(3, 120))), (205, " ".join(prose(3, 120)))]
    docs += [(206, "again " * 4000), (207, "again " * 3900), (None, " ".join(prose(7, 120)))]
    return docs


def brute_classes(docs):
    texts = sorted({t or "" for _, t in docs})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = near_dedup.split_words(a), near_dedup.split_words(b)
            longer = max(len(x), len(y))
            if min(len(x), len(y)) >= 0.8 * longer and near_dedup.edits_within(x, y, int(0.2 * longer + 1e-9)) is not None:
                root[find(a)] = find(b)
    least = {}
    for i, t in docs:
        if i is not None:
            k = find(t or "")
            least[k] = min(i, least.get(k, i))
    return Counter((i, least.get(find(t or ""))) for i, t in docs)


def test_classes_equal_brute_force(spark):
    docs = near_cases()
    got = near_dedup.class_of_each(table(spark, docs).repartition(4))
    expected = brute_classes(docs)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == expected
    rows = [(i, t, b"k", i) for i, t in docs]
    kept = near_dedup.one_of_each(table(spark, rows, "doc_id bigint, text string, key binary, rid bigint"))
    assert kept.columns == ["doc_id", "text", "key", "rid"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected})


def test_large_marks_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    docs = near_cases()
    got = near_dedup.class_of_each(table(spark, docs))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute_classes(docs)


def test_template_of_a_thousand_texts(spark):
    rng, template, docs, expected = random.Random(3), prose(1, 150), [], Counter()
    for i in range(0, 1000, 2):  # pairs at 0.81 to 0.92; other texts agree in three quarters
        own = [f"own{i}x{j}" for j in range(50)]
        other = list(own)
        for at in rng.sample(range(50), rng.randint(16, 38)):
            other[at] = f"new{i}x{at}"
        for d, words in ((i, own), (i + 1, other)):
            docs.append((d, " ".join(template + words)))
            expected[d, i] += 1
    got = near_dedup.class_of_each(table(spark, docs))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == expected


def test_texts_around_a_passage_give_few_pairs(spark, monkeypatch):
    rng, passage, seen, verified = random.Random(4), prose(1, 105), [], near_dedup.verified
    docs = [(i, " ".join(passage + [f"own{rng.randrange(2000)}" for _ in range(45)])) for i in range(400)]

    def counted(pairs, texts, similarity):
        seen.append(pairs.count())
        return verified(pairs, texts, similarity)

    monkeypatch.setattr(near_dedup, "verified", counted)
    got = near_dedup.class_of_each(table(spark, docs))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == Counter((i, i) for i in range(400))
    assert seen[1] < 400  # of 79,800 that share the passage


def test_close_pairs_leave_out_none_that_are_alike():
    rng, texts = random.Random(6), []
    for i in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 4, 5, 17, 60, 300]))]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(60)}"] * rng.randint(0, 2)
            texts.append((words, rng.randrange(100), rng.randrange(2)))
    texts.sort(key=lambda t: len(t[0]))
    hashes = near_dedup._Hashes()
    signatures = [near_dedup.signature_of(hashes.of(" ".join(t[0]))) for t in texts]
    sizes, parts, blocks = (np.array(x) for x in ([len(t[0]) for t in texts], [t[1] for t in texts], [t[2] for t in texts]))
    found = [p for a, b in near_dedup.close_pairs(sizes, parts, blocks, signatures, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)]
    alike = set()
    for v, (b, of, block) in enumerate(texts):
        for u, (a, other, its) in enumerate(texts[:v]):
            if of != other and block != its and near_dedup.edits_within(a, b, int(0.2 * len(b) + 1e-9)) is not None:
                alike.add((u, v))
    assert len(found) == len(set(found)) and alike <= set(found) and len(alike) > 100
    assert len(found) < 0.2 * len(texts) ** 2


@pytest.mark.parametrize("n", [5, 6, 12, 20, 30, 41, 60, 100, 250])
def test_candidates_near_the_threshold(n):
    rng, e, met = np.random.default_rng(n), n // 5, Counter()
    for spread in (False, True):
        for _ in range(50):
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            at = np.arange(e) * n // e + n // e // 2 if spread else rng.choice(n, e, replace=False)
            b = a.copy()
            b[at] = rng.integers(1, 1 << 62, e)
            first, second = (set(near_dedup.sketch_of(w, 3, near_dedup.SKETCHES, near_dedup.PICKED, 0.8).tolist()) for w in (a, b))
            met[spread] += bool(first & second)
    assert met[False] >= 48 and met[True] >= 45


def test_texts_that_fit_have_a_size_of_kmers_in_common():
    for longer in range(1, 300):
        for shorter in range(longer - longer // 5, longer + 1):
            assert set(near_dedup.sizes_of(longer)) & set(near_dedup.sizes_of(shorter))


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.class_of_each(table(spark, [])).collect() == []
    assert near_dedup.one_of_each(table(spark, [])).collect() == []


# --- substrings -------------------------------------------------------------
def test_gear_hash_depends_on_sixteen_bytes():
    data = np.frombuffer(" ".join(prose(4, 200)).encode(), np.uint8)
    gear, h, slow = substring_dedup._gear(), 0, []
    for b in data:
        h = (2 * h + int(gear[b])) % (1 << 16)
        slow.append(h)
    assert substring_dedup.rolling_hash(data).tolist() == slow


def test_repeated_passages_go(spark):
    passage = " ".join(prose(50, 80))
    docs = [(i, " ".join(prose(300 + i, 150))) for i in range(20)]
    docs += [(30 + i, " ".join(prose(400 + i, 20 + i)) + " " + passage + " é " + " ".join(prose(500 + i, 30))) for i in range(6)]
    docs += [(50, None), (51, ""), (52, "x"), (53, " ".join(prose(7, 40) * 100)), (None, passage), (54, docs[0][1]), (54, docs[0][1])]
    df = table(spark, [(i, t, 1) for i, t in docs], "doc_id bigint, text string, tie int").repartition(3)
    runs = {r.doc_id: r.runs for r in substring_dedup.repeated_runs(df).collect()}
    assert set(runs) == {30, 31, 32, 33, 34, 35, 53, 54}  # the passage stands first in the document without id
    assert all(x.source_id is None for i in range(30, 36) for x in runs[i]) and runs[54][0].source_id == 0
    texts = dict(docs)
    for i in range(30, 36):
        (run,) = runs[i]
        cut = texts[i].encode()[run.start : run.end].decode()
        assert cut.strip() in passage + " é" and len(cut) > len(passage) - 150
    kept = substring_dedup.without_repeats(df)
    assert kept.columns == df.columns
    for r in kept.collect():
        data, at, out = (texts[r.doc_id] or "").encode(), 0, b""
        for x in runs.get(r.doc_id, []):
            out, at = out + data[at : x.start], x.end
        assert r.text == (None if texts[r.doc_id] is None else (out + data[at:]).decode())
    assert substring_dedup.repeated_runs(table(spark, [])).collect() == []


def test_insertions_shift_no_cut():
    words = prose(6, 400)
    first, second = " ".join(words).encode(), " ".join([*words[:5], "inserted", *words[5:]]).encode()
    a, b = ({t[x:y] for x, y in zip(*substring_dedup.chunk_places([t])[1:], strict=True)} for t in (first, second))
    assert len(a & b) > 0.9 * len(a)


# --- url filters ------------------------------------------------------------
def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org", "https://x.com/de/5#a", "https://xcom/de/5",
        "ftp://u@h.com:80/de/2", "x://y.org?/es/", "http://a.com//de/1", "http://a.com/de/1", "http://a.com/de/1",
    ]
    pages = table(spark, [(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rows = {r.page_id: r for r in url_filters.judged(pages, rules).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "", None), ("x.com", "/de/5", "com/de/"), ("xcom", "/de/5", None), ("u@h.com:80", "/de/2", None),
        ("y.org", "", None), ("a.com", "//de/1", None), ("a.com", "/de/1", "com/de/"), ("a.com", "/de/1", "com/de/"),
    ]
    assert url_filters.judged(table(spark, [], "page_id bigint, url string"), rules).collect() == []


def test_templates(spark):
    blocked = [(f"http://h.com/spam/{i}", "/spam/") for i in range(40)]
    fine = [(f"http://h.com/{s}/{i}", None) for s in ("news", "blog") for i in range(40)]
    slugs = [(f"http://h.com/item/{''.join(prose(i, 2))}", None) for i in range(40)]
    pages = table(spark, [(i, u) for i, (u, _) in enumerate(blocked + fine + slugs)], "page_id bigint, url string")
    rules = [("h.com", "/spam/1", "block"), ("h.com", "/spam/2", "block"), ("h.com", "/news/", "allow"), ("h.com", "/blog/", "allow"), ("h.com", "/item/", "allow")]
    rows = url_filters.judged(pages, rules).collect()
    found = {r.template for r in rows}
    assert found == {"/*+/<n>", "/*-/<n>", "/*-/*"}  # spam stands out; the other branches are alike, and so are slugs
    unruled = [r for r in rows if r.rule is None]
    assert unruled and all(r.verdict == "block" and r.purity > 0.9 for r in unruled)


# --- chats ------------------------------------------------------------------
@pytest.mark.parametrize("text", ["", "\\", "\\\\l", "#<:", "\\h\\\\", "### a: </turn>\n", "é\n\n", "\\### Assistant: </turn> ok"])
def test_escapes_are_reversible(spark, text):
    row = table(spark, [(1, text)]).select(
        chat.escaped(F.col("text")).alias("e"), chat.unescaped(chat.escaped_role(F.col("text"))).alias("r")
    ).first()
    assert row.r == text and "#" not in row.e and "<" not in row.e


def test_reply_trees(spark):
    #      1            9 (alone)     20 -> 21 -> 20 is a cycle
    #    2   3
    #   4 5   6
    rows = [
        (1, None, "system", "s", None), (2, 1, "user", "u2", 1.0), (3, 1, "user", None, 2.0), (4, 2, "assistant", "a4", 3.0),
        (5, 2, "assistant", "a5", 3.0), (6, 3, "assistant", "a#6", 2.0), (9, 77, None, "<9>", 0.0), (20, 21, "user", "x", 9.0),
        (21, 20, "user", "y", 9.0), (22, 21, "user", "z", 9.0),
    ]
    df = table(spark, rows, "node bigint, parent bigint, role string, text string, score double")
    best = {r.root: r for r in chat.chat_paths(df, score="score").collect()}
    assert {k: v.leaf for k, v in best.items()} == {1: 4, 9: 9}  # 4, 5 and 6 score 4: the least leaf wins
    assert best[1].formatted == "### system: s</turn>\n### user: u2</turn>\n### assistant: a4</turn>\n"
    assert best[9].formatted == "### : \\l9></turn>\n" and best[9].mask == []
    everything = chat.chat_paths(df, score="score", best=None).orderBy("root", "rank").collect()
    assert [(r.root, r.rank, r.leaf) for r in everything] == [(1, 1, 4), (1, 2, 5), (1, 3, 6), (9, 1, 9)]
    read = chat.chat_paths(df, score="score", best=None).where("leaf = 6").select(
        chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("m")
    ).first()
    assert [(t.role, t.text) for t in read.t] == [("system", "s"), ("user", ""), ("assistant", "a#6")] and read.m == "a#6"
    assert chat.chat_paths(df.limit(0)).collect() == []


def test_long_chains(spark):
    df = spark.range(300).select("id", (F.col("id") - 1).alias("up"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    df = df.withColumn("up", F.when(F.col("up") >= 0, F.col("up")))
    (row,) = chat.chat_paths(df, node="id", parent="up").collect()
    assert row.n_turns == 300 and row.formatted == "".join(f"### user: {i}</turn>\n" for i in range(300))


# --- toxicity ---------------------------------------------------------------
def test_disguised_words_are_restored(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(prose(i, 60) + rng.choices(["idiot", "stupid", "loser"], k=3))) for i in range(60)]
    costs = toxicity.language_model(toxicity.trigram_counts(table(spark, texts)))
    restorer = toxicity.Restorer(costs)
    for token, word in [("1d10t", "idiot"), ("stuuupid", "stupid"), ("l0$er", "loser"), ("i.d.i.o.t", "idiot"), ("idi*t", "idiot"), ("loser!!!", "loser"), ("kalo", "kalo")]:
        assert restorer.words(token) == [word]
    assert restorer.spaced("ka i d i o t lo") == ["idiot"]
    assert restorer.words("2024") == [] and restorer.words("###") == [] and restorer.words("") == []
    assert len("".join(restorer.words("x1" * 5000))) >= 5000


def brute_trigrams(texts):
    total = Counter()
    for text in texts:
        classes = [int(toxicity.CLASSES[min(ord(c), 256)]) for c in f" {text.lower()} "]
        words = [[]]
        for c in classes:
            if c:
                words[-1].append(c)
            elif words[-1]:
                words.append([])
        flat = [0, 0]
        for w in words:
            if w:
                flat += [*w, 0, 0]
        total.update((a * 64 + b) * 64 + c for a, b, c in zip(flat, flat[1:], flat[2:], strict=False))
    return total


def test_trigrams_equal_brute_force(spark):
    texts = ["", "ab", "  a  b!! ", "Ünïcode ß日本 x1y", " ".join(prose(1, 500))]
    got = {r.code: r.n for r in toxicity.trigram_counts(table(spark, list(enumerate(texts)))).collect()}
    assert got == dict(brute_trigrams(texts))


def test_scores(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = prose(i, 50)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "1d10t", "stupid", "stuuupid"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "stupid"), (5, "repeated id"), (1002, " ".join(prose(1, 30000)) + " i d i o t")]
    labels += [(None, 1), (7, None), (9999, 1)]
    docs, marks = table(spark, rows), table(spark, labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    scored = toxicity.with_score(docs.withColumn("score2", F.lit(1)), model, "text").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.text != "repeated id"]
    right = sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
    by = {r.doc_id: r.score for r in scored}
    assert by[1000] == by[1001] and by[1002] >= 0.3 and by[None] >= 0.3
    wide = docs.withColumn("score", F.lit("mine"))
    kept = toxicity.without_toxic(wide, marks)
    assert kept.columns == wide.columns and kept.where("doc_id = 1001").count() == 1
    none = table(spark, [], "doc_id bigint, toxic int")
    assert toxicity.without_toxic(docs, none, threshold=0.6).count() == len(rows)
    assert toxicity.with_score(table(spark, []), toxicity.fit(table(spark, []), none), "text").collect() == []


# --- fingerprints -----------------------------------------------------------
def test_fingerprints_are_homomorphic(spark):
    a, b = [" ".join(prose(i, 8)) for i in range(6)], [" ".join(prose(i, 8)) for i in range(20, 25)]
    rows = [(0, "\n".join(a)), (1, "\n".join(reversed(a))), (2, "\n".join(b)), (3, "\n".join(a + b)), (4, None), (5, ""), (6, "\n".join([*a, a[0]]))]
    df = fingerprints.fingerprints(table(spark, rows), name="v")
    v = {r.doc_id: r.v for r in df.collect()}
    assert v[0] == v[1] != v[2] and v[4] == v[5] and set(v[4]) == {0} and v[6] != v[0]
    x, y, z = (df.where(f"doc_id = {i}").select(F.col("v").alias(n)) for i, n in ((0, "x"), (2, "y"), (3, "z")))
    joined = x.crossJoin(y).crossJoin(z)
    row = joined.select(
        fingerprints.plus(F.col("x"), F.col("y")).alias("sum"), fingerprints.minus(F.col("z"), F.col("y")).alias("rest"),
        fingerprints.likeness(F.col("x"), F.col("z")).alias("part"), fingerprints.likeness(F.col("x"), F.col("y")).alias("none"),
        fingerprints.likeness(F.col("x"), F.col("x")).alias("same"),
    ).first()
    assert row.sum == v[3] and row.rest == v[0] and row.same == 1.0
    assert 0.4 < row.part < 1 and row.none < 0.35


def test_edited_texts(spark):
    rng = random.Random(4)
    rows = [(i, "é".join(prose(i, rng.randint(0, 30)))) for i in rng.sample(range(1000), 40)]
    rows += [(2000, None), (2001, "x"), (None, "no id"), (3, "tie one"), (3, "tie two"), (2002, "same"), (2002, "same")]
    df = table(spark, [(i, t, 0) for i, t in rows], "doc_id bigint, text string, key int").repartition(3)
    got = fingerprints.edited_likeness(df).collect()

    def digest(row):
        return hashlib.md5(f"{'null' if row[0] is None else row[0]} {row[1] or ''}".encode()).hexdigest()

    order = sorted(sorted(set(rows), key=digest), key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = {}
    for at, row in enumerate(order):
        text, following = row[1] or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected[row] = text[: len(text) - half] + following[:half]
    assert Counter((r.doc_id, r.edited) for r in got) == Counter((row[0], expected[row]) for row in rows)
    assert fingerprints.edited_likeness(table(spark, [])).collect() == []
    (alone,) = fingerprints.edited_likeness(table(spark, [(1, "abcdef")])).collect()
    assert alone.edited == "abcabc"
