"""Each training-data operator against a brute-force version, on small and awkward tables."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import (common, decontamination, fingerprints, line_duplicates, near_duplicates, packing,
                          personal_data, substrings, token_files, tokens, toxicity, transcripts)
from newsloom.llm.common import folded_words, plain_words
from newsloom.llm.components import components
from newsloom.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __copy string"
LONG = " ".join(f"word{k % 700} other{k % 13}" for k in range(6000))
BASE = " ".join(f"alpha{k} beta{k % 7}" for k in range(60))
AWKWARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, BASE), (5, BASE), (5, BASE + " one more"), (6, BASE.upper()),
    (7, "Ünï çødé wörds " * 9 + "\nline two.\nline two."), (7, "Ünï çødé wörds " * 9 + "\nline two.\nline two."),
    (8, LONG), (9, LONG[: len(LONG) // 2] + " tail " + BASE), (None, BASE.replace("alpha9 ", "x ")),
    (None, None), (10, "mail a.b@c.de_x@y.org, 10.0.0.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (212) 555-0100"),
    (11, "one two"), (12, "one two"), (13, "a b c d e\na b c d e f\nb a c e d"), (2**53 + 1, "one two three")]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None, "s", None, "kept") for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(docs, name):
    path = public_tokenizers.path(name)
    texts = [t for _, t in AWKWARD] + [r[0] for r in docs.select("text").limit(80).collect()] + [
        "a\n b", "a  b", " a", "a ", "x's it's", "<|endoftext|> a", "a\tb c", "1 2\n3", "a\n\nb c",
        "İx Y", "a\x1cb \x1cd", "a\n  b", "x.́ y", "\n"]
    ids, starts = encoder(path).encode(texts)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for k, text in enumerate(texts):
        assert ids[starts[k]:starts[k + 1]].tolist() == whole.encode(
            text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_with_added_tokens_equals_the_tokenizer_as_it_is(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    strings = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert strings
    texts = [text for s in strings + ["<|startoftext|>", "<|EndOfText|>", "<|end"] for text in (
        s, f"one {s} two", f"one{s}two, three", f"{s}{s}\nfour", f" {s} ", f"{s.upper()} a b")]
    texts += [t for _, t in AWKWARD if t]
    ids, starts = encoder(path, True).encode(texts)
    for k, text in enumerate(texts):
        assert ids[starts[k]:starts[k + 1]].tolist() == whole.encode(
            text, add_special_tokens=False).ids, text


def encoded(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(awkward, path).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for members in windows.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == members[0].size <= 2048 and at & (at - 1) == 0
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for doc in (1, 4, 8, 9, 10):
        ids = encoded(path, dict(AWKWARD)[doc], 1)
        got = b"".join(r.ids for r in sorted(pieces[doc], key=lambda r: r.start))
        assert got == ids.tobytes() and pieces[doc][0].doc_tokens == len(ids)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_and_token_files_keep_added_tokens(spark, tmp_path):
    text = "one two <|endoftext|> three"
    df = spark.createDataFrame([(1, text), (2, "four")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(df.coalesce(1), path).filter("doc_id = 1").collect()
    assert b"".join(r.ids for r in sorted(pieces, key=lambda r: r.start)) == encoded(
        path, text, 1).tobytes()
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(df, str(tmp_path / "a"), path)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "a")).collect()}
    assert got[1].ids == encoded(path, text, 2).tobytes() and got[2].start == got[1].n_tokens


def test_step_groups_are_even():
    windows = [[packing._Piece((0, n), 0, np.zeros(n, "<u4"))] for n in [256] * 600 + [2048] * 70]
    groups = packing.step_groups(windows, 65_536)
    sizes = defaultdict(list)
    for w, g in zip(windows, groups):
        sizes[g].append(len(w[0].ids))
    assert all(len(set(s)) == 1 for s in sizes.values())
    assert max(len(s) for s in sizes.values() if s[0] == 2048) <= 36


def test_fingerprints(awkward, empty):
    rows = fingerprints.compare_edited(awkward).collect()
    assert len(rows) == len(AWKWARD)
    prints = defaultdict(set)
    for r in rows:
        prints[r.n_chars, r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[len(BASE), 4] == prints[len(BASE), 5]
    ordered = sorted(((i, t or "") for i, t in AWKWARD if i is not None and i > 7), key=key)
    following = {a[0]: b[1] for a, b in zip(ordered, ordered[1:])}
    for r in rows:
        if r.doc_id in following:
            text = dict(AWKWARD)[r.doc_id] or ""
            half = len(text) // 2
            edited = text[:len(text) - half] + following[r.doc_id][:half]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.compare_edited(empty).count() == 0


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([(1, "p one\nq two"), (2, "q two\np one"), (3, "p one"), (4, "q two")],
                               "k int, text string")
    rows = {r.k: r for r in fingerprints.fingerprint(df, "k").collect()}
    assert rows[1].fingerprint == rows[2].fingerprint != rows[3].fingerprint
    pair = spark.createDataFrame([(rows[3].lanes, rows[4].lanes, rows[1].lanes)],
                                 "a array<long>, b array<long>, c array<long>")
    added = pair.select(fingerprints.add(F.col("a"), F.col("b")),
                        fingerprints.add(F.col("c"), F.col("b"), -1)).first()
    assert added[0] == rows[1].lanes and added[1] == rows[3].lanes


def test_token_files(spark, awkward, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(awkward, str(tmp_path / "a"), path, block_bytes=2000)
    rows = token_files.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    at = 0
    for row, (i, t) in zip(rows, sorted(AWKWARD, key=key), strict=True):
        ids = encoded(path, t, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (i, at, len(ids), ids.tobytes())
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    some = token_files.read_documents(spark, str(tmp_path / "a"), [8, 11]).collect()
    assert {(r.doc_id, r.ids) for r in some} == {
        (k, encoded(path, dict(AWKWARD)[k], 2).tobytes()) for k in (8, 11)}
    token_files.write_token_files(empty, str(tmp_path / "b"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_decontamination(spark, awkward, empty):
    items = [(1, BASE[:200]), (2, "one TWO"), (3, None), (None, "line two"), (1, BASE[:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        words = folded_words(t)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k:k + n])].add("null" if i is None else str(i))
    want = []
    for i, t in AWKWARD:
        words, hit, names = folded_words(t), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k:k + n])):
                    names |= found
                    hit.update(range(k, k + n))
        want.append((i, len(words), sorted(hit), sorted(names)))
    want.sort(key=str)
    for limit in (1 << 20, 0):
        got = decontamination.contamination(awkward, bench, broadcast_bytes=limit)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        for mode in ("documents", "spans"):
            left = decontamination.decontaminate(awkward, bench, mode, broadcast_bytes=limit)
            assert left.columns == awkward.columns
            again = decontamination.contamination(left, bench)
            assert again.filter("size(hit_words) > 0").count() == 0
            clean = sum(not w[2] for w in want)
            assert left.count() == (clean if mode == "documents" else len(want))
    assert decontamination.contamination(empty, bench).count() == 0


def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = folded_words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else
                    {tuple(w)} if w else set())
    return [[j for j in range(len(sets)) if i != j and sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
            for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, awkward, empty, block):
    rows = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    links = jaccard_truth(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, block=block).collect()}
    assert [got[k].n_links for k, _ in rows] == [len(x) for x in links]
    for k, _ in rows:
        group, todo = {k}, [k]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        assert got[k].class_id == min(group) and got[k].keep == (k == min(group))
    if block == 2:
        assert near_duplicates.near_duplicates(awkward).count() == len(AWKWARD)
        assert near_duplicates.drop_near_duplicates(awkward).columns == awkward.columns
        assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_of_doubled_texts(spark):
    base = [f"alpha{k}" for k in range(300)]
    rows = [(k, " ".join(base[:295] + [f"own{k}"] + base[296:])) for k in range(20)]
    rows += [(20 + k, t + " " + t) for k, t in rows[:6]] + [(30, " ".join([rows[0][1]] * 4))]
    links = jaccard_truth(rows)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert [got[i].n_links for i, _ in rows] == [len(x) for x in links]
    assert {r.class_id for r in got.values()} == {0} and sum(r.keep for r in got.values()) == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (7, 7), (None, 3)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len({roots[k] for k in range(41)}) == 1 and roots[100] == roots[200] != roots[0]


def test_transcripts(spark, folder):
    made = transcripts.as_transcripts(spark.read.parquet(f"{folder}/conversations.parquet"))
    rows = transcripts.parse(made, transcripts.fit(made)).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.n_right for r in held) >= 0.8 * sum(r.n_lines for r in held)
    assert all(r.rendered.count("<|end|>") >= r.n_turns for r in rows)
    odd = spark.createDataFrame([(1, None, "user", "hi"), (1, 0, None, None), (None, 900, "system", "x"),
                                 (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    odd = transcripts.as_transcripts(odd)
    assert transcripts.parse(odd, transcripts.fit(odd)).count() == 2


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_personal_data(awkward, docs, empty):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
              lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+",
              lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    for df in (awkward, docs):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds)
                           for m in re.finditer(p, r.text or "") if ok(m.group()))
            base = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
            texts[r.doc_id].append((hashlib.sha256(base.encode()).hexdigest(),
                                    *[sum(s[3] == n for s in spans) for n, _, _ in kinds]))
        got = defaultdict(list)
        for r in personal_data.find_personal_data(df).collect():
            got[r.doc_id].append((r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert personal_data.find_personal_data(empty).count() == 0


def test_ip_parts_of_zeros(spark):
    addresses = ["10.0.0.1", "0.0.0.0", "127.0.0.1", "00.1.2.3", "000.000.000.000", "0255.1.2.003",
                 "192.168.0.10", "10.0.0.256", "0256.1.2.3", "1.2.3.0999", "300.0.0.1"]
    rows = [(k, f"at {a} now") for k, a in enumerate(addresses)]
    got = {r.doc_id: (r.n_ip, r.spans) for r in personal_data.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, a in enumerate(addresses):
        good = all(int(p) <= 255 for p in a.split("."))
        assert got[k] == ((1, f"ip:3:{3 + len(a)}") if good else (0, "")), a


def test_bootstrapped_contexts(spark):
    rows = [(k, f"write to contact user{k}@mail{k}.org now") for k in range(9)]
    rows += [(50, "write to contact user77@intranet now"), (51, "nothing about user78@intranet now")]
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].startswith("email:17:") and got[51] == ""


def test_unseen_identifiers_get_their_whole_span(spark):
    def luhn_card(k):
        head = f"4111 1111 {k:04d} 000"
        return next(head + c for c in "0123456789" if luhn(re.sub(" ", "", head + c)))

    rows = [(k, f"please dial +1 (212) 555-01{k:02d} for more help") for k in range(20)]
    rows += [(100 + k, f"paid by card {luhn_card(k)} on that day") for k in range(20)]
    rows += [(200 + k, f"mail=user{k}@mail{k}.org") for k in range(20)]
    planted = {300: ("phone", "please dial ", "212 555 0100", ", friend"),
               301: ("phone", "ring ", "(212) 555-0177", " for more help"),
               302: ("phone", "dial ", "(212) 555-0188", " at noon"),
               303: ("card", "by card ", "4111 1111 1111 1112", " again"),
               304: ("email", "your mail=", "someone@intranet", " here"),
               305: (None, "there are 12 555 0100 of them", "", "")}
    rows += [(k, a + v + b) for k, (_, a, v, b) in planted.items()]
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (kind, a, v, _) in planted.items():
        assert got[k] == (f"{kind}:{len(a)}:{len(a) + len(v)}" if kind else ""), k


def test_toxicity():
    import random

    rng = random.Random(5)
    plain = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti", "ve", "zu"]

    def text(bad):
        words = ["".join(rng.choices(plain, k=rng.randint(1, 4))) for _ in range(120)]
        for w in bad:
            words[rng.randrange(120)] = w
        return " ".join(words)

    foul = ["wretchgrub", "snarlhoof", "muckfiend"]
    toxic, ordinary = [text(foul) for _ in range(90)], [text([]) for _ in range(240)]
    model = toxicity.train(toxic, ordinary)
    bad, good = model.scores([text(foul) for _ in range(40)]), model.scores(
        [text([]) for _ in range(40)] )
    assert (bad >= 0.7).mean() >= 0.9 and (good >= 0.7).mean() <= 0.1
    assert all(0 <= s <= 1 for s in model.scores([None, "", "a"]))


def test_toxicity_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_lines(spark, awkward, empty):
    rows = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    seen, want = [], {}
    for k, t in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            words = set(folded_words(line))
            if not words or not any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        want[k] = (k, len(lines), len(lines) - len(kept),
                   hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r) for r in line_duplicates.line_report(df).collect()} == want
    assert line_duplicates.line_report(awkward).count() == len(AWKWARD)
    assert line_duplicates.line_report(empty).count() == 0


def test_many_similar_lines_take_the_second_pass(spark, monkeypatch):
    monkeypatch.setattr(line_duplicates, "FEW", 1)
    monkeypatch.setattr(line_duplicates, "BEST", 2)
    rows = [(k, " ".join(f"w{j}" for j in range(40) if j % 10 != k % 10) + f" x{k} y{k}")
            for k in range(30)]
    seen, want = [], {}
    for k, t in rows:
        words = set(folded_words(t))
        want[k] = int(any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen))
        seen.append(words)
    got = line_duplicates.line_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_substrings(spark, awkward, empty):
    rows = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    seen, want = set(), {}
    for k, t in rows:
        words = plain_words(t)
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[k] = (k, len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(df, with_text=False).collect()
    assert {r.doc_id: tuple(r) for r in got} == want
    assert substrings.remove_repeats(awkward).count() == len(AWKWARD)
    assert substrings.remove_repeats(empty).count() == 0


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.agg(F.sum("length")).first()[0] > before


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_of_few_words(spark, seed):
    """Small vocabularies make pairs that pass the cheap filters and none of the dear ones."""
    draw = np.random.default_rng(seed)
    rows = [(k, "\n".join(" ".join(f"w{j}" for j in draw.integers(0, 60, draw.integers(0, 9)))
                          for _ in range(draw.integers(1, 9)))) for k in range(150)]
    seen, want = [], {}
    for k, t in rows:
        sets = [set(folded_words(line)) for line in t.split("\n")]
        want[k] = 0
        for words in filter(None, sets):
            want[k] += any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen)
            seen.append(words)
    got = line_duplicates.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_lines_around_the_length_that_gets_tallies(spark):
    """Similar lines just under, at and far over ``LONG`` words, some with over 400 words."""
    draw, rows = np.random.default_rng(5), []
    for size in (120, 150, 158, 160, 163, 190, 420):
        base = [f"v{j}" for j in draw.integers(0, 900, size)]
        for swapped in (0, 4, size // 12, size // 9, size // 8, size // 4):
            words = list(base)
            for place in draw.choice(size, swapped, replace=False):
                words[place] = f"v{draw.integers(0, 900)}"
            rows.append((len(rows), " ".join(words[:size - swapped // 3])))
    seen, want = [], {}
    for k, t in rows:
        words = set(folded_words(t))
        want[k] = int(any(len(words & s) >= 0.8 * len(words | s) - 1e-9 for s in seen))
        seen.append(words)
    assert 10 < sum(want.values()) < len(rows) - 10
    got = line_duplicates.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


CLASHES = ("doc_id", "text", "__copy", "__hash", "__hit", "__digest", "row", "copy", "lines", "id", "d", "c", "__may")


def test_names_that_clash(spark, awkward, empty):
    more = [F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in CLASHES[2:]]
    for table in (awkward.select("doc_id", "text", *more), empty.select("doc_id", "text", *more)):
        items = awkward.filter("doc_id IN (4, 9)").select(F.col("doc_id").alias("item_id"), "text")
        jobs = [lambda: line_duplicates.drop_repeated_lines(table),
                lambda: near_duplicates.drop_near_duplicates(table)]
        jobs += [lambda way=way, size=size: decontamination.decontaminate(
            table, items, way, broadcast_bytes=size) for way in ("documents", "spans") for size in (0, 1 << 20)]
        rows = [sorted(job().collect(), key=repr) for job in jobs]
        assert rows[2] == rows[3] and rows[4] == rows[5]
        for found in rows:
            for r in found:
                assert r.asDict().keys() == set(table.columns)
                assert r.doc_id is None or all(r[n] == f"{n}{r.doc_id}" for n in CLASHES[2:])


def test_strings_are_listed_without_scalars():
    """An object for each string on the way took longer than cutting and hashing them."""
    words = [f"w{k}" for k in range(300)] + ["", "é", "日本"]
    for kind in (pa.string(), pa.large_string()):
        assert common.listed(pa.array(words, kind)) == words
    assert common.listed(pa.array([w.encode() for w in words], pa.large_binary())) == [w.encode() for w in words]
    assert common.listed(pa.array([], pa.large_string())) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_put_together_in_place(name):
    """The ids are the taken parts themselves: no index for each id is made beside them."""
    import tracemalloc

    encoder = tokens.WordEncoder(public_tokenizers.path(name))
    encoder.encode(["the cat sat"])
    texts = ["the cat sat " * 20_000 + "on", None, "", "the cat"]
    encoder.encode(texts)
    tracemalloc.start()
    ids, starts = encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for text, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert most < 2 * ids.nbytes + (1 << 20)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_in_slices_and_with_few_kept_parts(monkeypatch, name):
    """Slices, batches of new words and dropped parts leave the ids as they are."""
    monkeypatch.setattr(tokens, "SLICE", 300)
    monkeypatch.setattr(tokens, "KEPT_PARTS", 40)
    model = tokens.WordEncoder(public_tokenizers.path(name))
    texts = [t for _, t in AWKWARD] + [" ".join(f"w{chr(97 + k % 26)}{chr(97 + j)}q, x{j}" for j in range(26))
                                       for k in range(60)]
    for part in (texts, texts[::-1], texts[:1], [], texts[20:30] * 3):
        ids, starts = model.encode(part)
        assert len(starts) == len(part) + 1 and starts[-1] == len(ids)
        for text, a, b in zip(part, starts, starts[1:]):
            assert ids[a:b].tolist() == model.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert len(model.words) == len(model.ids) <= 40 + 26 * 30


@pytest.mark.skipif(not os.path.exists("/proc/self/clear_refs"), reason="memory is read from /proc")
def test_an_encoder_takes_little_memory_beside_its_tokenizer():
    """8 MB of text with many distinct words took a worker over 200 MB, twice in an executor."""
    program = f"""
import random, re
from newsloom.llm import tokens
def memory():
    found = dict(re.findall(r"(VmHWM|RssAnon|RssFile):\\s+(\\d+)", open("/proc/self/status").read()))
    return int(found["VmHWM"]) - int(found["RssFile"])
model = tokens.WordEncoder({public_tokenizers.path("word_bpe_49k.json")!r})
model.encode(["a b"])
pick = random.Random(1)
words = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(150_000)]
texts = [" ".join(pick.choices(words, k=400)) for _ in range(2600)]
open("/proc/self/clear_refs", "w").write("5")
before = memory()
model.encode(texts)
print((memory() - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True,
                         env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(out.stdout) < 140
