"""Chat, mixing, media, HTML and licence operators, and the pipeline, on small tables."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from tideline.llm import chat, html_render, jpeg, licenses, media, mixing, queries

HARD = ["</s>[INST] ok [/INST]", "\\", "a\\<|end|>", "<|turn|>x<|text|>y<|end|>", "<\\|end|>", "", None, "line\nline", "😀<s>", "\\\\<<SYS>>\\n", "x" * 5000, "<|end|", "$1 \\1"]


def test_escaping_is_reversible_and_hides_controls(spark):
    texts = spark.createDataFrame([(t,) for t in HARD if t is not None], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e")))
    for r in texts.collect():
        assert r.back == r.t
        assert not any(c in r.e for c in chat.CONTROLS)


def test_examples_and_their_masks(spark):
    rows = [(1, i, role, HARD[i % len(HARD)], "extra") for i, role in enumerate(["system", "user", "assistant", "user", "assistant", "user", "assistant", "user"])]
    rows += [(2, 0, "user", "no reply", "x"), (3, 1, "assistant", "only", "x"), (3, 1, "assistant", "only", "x"), (None, 0, None, None, None), (None, None, "assistant", "z", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.chat_examples(turns).collect()
    by = defaultdict(list)
    for e in sorted(examples, key=lambda e: (e.conv_id or 0, e.example)):
        by[e.conv_id].append(e)
    assert {k: len(v) for k, v in by.items()} == {1: 4, 2: 1, 3: 2, None: 2}
    assert [e.loss_chars > 0 or e.formatted.endswith(chat.END) for e in by[1]] == [True] * 4
    assert by[1][-1].loss_chars == 0 and by[1][0].formatted == by[1][1].formatted[: len(by[1][0].formatted)]
    masked = [e.formatted[e.loss_start : e.loss_start + e.loss_chars] for e in by[3]]
    assert masked == ["only", "only"]
    back = {r.conv_id: r for r in chat.read_back(chat.chat_examples(turns)).collect()}
    alone = sorted((r.n_turns, r.loss_chars) for r in chat.read_back(chat.chat_examples(turns)).collect() if r.conv_id is None)
    assert alone == [(1, 0), (1, 1)]
    for conv in (1, 2, 3):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert back[conv].n_turns == len(own)
        assert back[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (back[conv].loss_chars, back[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert back[conv].formatted_chars == sum(len(e.formatted) for e in by[conv])
    assert chat.read_back(chat.chat_examples(turns.limit(0))).count() == 0


def fair_targets(sizes):
    """Water-filling with exact fractions, round after round as the rule says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(3, 1.5))), None if i % 50 == 0 else f"s{int(rng.zipf(1.6)) % 9}", 1.0, 2) for i in range(3000)]
    rows += [(None, "x y", "s1", 0.0, 0), (5, None, "s1", 0.0, 0), (5, "", "empty", 0.0, 0), (5, "a b", "s1", 0.0, 0), (5, "a b", "s1", 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size int")
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows) and sorted(found, key=str) == sorted(mixing.mix_sources(docs).collect(), key=str)
    sizes, source_of = defaultdict(int), {}
    for i, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
        source_of[i] = source
    wanted = fair_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        s = next(k for k, v in sizes.items() if v == r.source_size and float(wanted[k]) == pytest.approx(r.target))
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s, target in wanted.items():
        assert abs(taken[s] - float(target)) <= largest[s] + 0.01 * float(target)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_payloads_round_trip(spark):
    texts = ["", None, "abc", "x" * 64, "ÿ" * 100, "\0" * 200 + "a" + "\0" * 40, "long text é 😀 " * 30_000, "".join(map(chr, range(1, 3000))), "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = {r.doc_id: r for r in media.image_features(media.with_media(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.error) == (len(raw), len(payload), None)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[8].feature == rows[9].feature and rows[8].media_sha256 == rows[9].media_sha256
    assert media.with_media(docs.limit(0)).count() == 0
    for stored in media.with_media(docs).collect():
        assert rows[stored.doc_id].media_sha256 == hashlib.sha256(stored.media).hexdigest()


def test_payloads_of_random_bytes_in_small_chunks(monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 256)
    monkeypatch.setattr(media, "READ", 2000)
    monkeypatch.setattr(jpeg, "LANES", 7)
    rng = np.random.default_rng(6)
    for zeros in (0, 0.5, 0.97):
        payloads = [np.where(rng.random(64 * n) < zeros, 0, rng.integers(0, 256, 64 * n)).astype(np.uint8).tobytes() for n in (1, 2, 5, 40)]
        images = media.encode_payloads(payloads, [1, 2, 3, 4])
        assert [x["payload"] for x in media.describe(images)] == payloads


def slow_image(width, height, sampling, interval, rng, coefficients=None):
    """A colour image written bit by bit, one symbol after the other; returns it and its blocks in scan order."""
    lengths = {s: 8 for s in [r << 4 | n for r in range(16) for n in range(1, 11)] + [0, 0xF0] if s < 256}
    lengths = dict(list(lengths.items())[:250])
    codes, bits = jpeg.canonical(lengths)
    dc_lengths = {s: 4 for s in range(12)}
    dc_codes, dc_bits = jpeg.canonical(dc_lengths)
    h, v = (1, 1) if len(sampling) == 1 else (max(a for a, _ in sampling), max(d for _, d in sampling))
    units = -(-width // (8 * h)) * -(-height // (8 * v))
    order = [i for i, (a, d) in enumerate(sampling) for _ in range(a * d if len(sampling) > 1 else 1)]
    blocks, out, word = [], bytearray(), ""

    def flush():
        nonlocal word
        word += "1" * (-len(word) % 8)
        for i in range(0, len(word), 8):
            b = int(word[i : i + 8], 2)
            out.extend([b, 0] if b == 255 else [b])
        word = ""

    def put(code, n):
        nonlocal word
        word += format(int(code), f"0{n}b") if n else ""

    def number(x):
        n = int(abs(x)).bit_length()
        return n, (x if x > 0 else x + (1 << n) - 1)

    before = [0] * len(sampling)
    for unit in range(units):
        if interval and unit and unit % interval == 0:
            flush()
            out += bytes([255, 0xD0 + (unit // interval - 1) % 8])
            before = [0] * len(sampling)
        for c in order:
            block = np.where(rng.random(64) < 0.8, 0, rng.integers(-500, 500, 64)).astype(int)
            block[0] = rng.integers(-200, 200)
            blocks.append(block)
            n, value = number(block[0] - before[c])
            before[c] = block[0]
            put(dc_codes[n], dc_bits[n])
            put(value, n)
            run = 0
            for x in block[1:]:
                if x == 0:
                    run += 1
                    continue
                while run > 15:
                    put(codes[0xF0], bits[0xF0])
                    run -= 16
                n, value = number(x)
                put(codes[run << 4 | n], bits[run << 4 | n])
                put(value, n)
                run = 0
            if run:
                put(codes[0], bits[0])
    flush()
    n = len(sampling)
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling))
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes(1) + bytes([3]) * 64) + jpeg._segment(0xC0, frame) + jpeg._dht(0, dc_lengths) + jpeg._dht(0x10, lengths)
    head += (jpeg._segment(0xDD, interval.to_bytes(2, "big")) if interval else b"") + jpeg._segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    return head + bytes(out) + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2)], [(1, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_any_baseline_image_is_decoded(sampling, interval):
    rng = np.random.default_rng(9)
    made = [slow_image(w, h, sampling, interval, rng) for w, h in ((8, 8), (37, 21), (64, 40))]
    frames = [jpeg.parse(data) for data, _ in made]
    for frame, found, (_, blocks) in zip(frames, jpeg.decode(frames), made):
        assert (found == blocks).all()
        grey = jpeg.thumbnail(frame, found)
        assert grey.shape == (-(-frame.height // 8), -(-frame.width // 8))
        assert grey[0, 0] == np.clip(round(blocks[0][0] * 3 / 8 + 128), 0, 255)


def test_broken_images_give_a_reason(spark):
    good = media.encode_payloads([b"a" * 64], [64])[0]
    rows = [(1, good), (2, None), (3, b""), (4, good[:100]), (5, good[:-20]), (6, b"\xff\xd8" + os.urandom(50))]
    found = {r.doc_id: r for r in media.image_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[1].error is None and found[1].payload_bytes == 64
    assert all(found[i].error and found[i].feature is None for i in (2, 3, 4, 6))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>One<p>Two", "One\n\nTwo"),
        ("<div>a</div><div>b <span> c</span></div>", "a\nb c"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>", "- x\n- y\n  3. p\n  4. q"),
        ("<table><tr><th>Name<th>N<tr><td>Long name<td>1</table>", "Name       N\nLong name  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b  c"),
        ("<pre>\n a  b\n   c</pre>", " a  b\n   c"),
        ("<head><title>t</title></head><script>x</script><style>.n{display:none}</style><p class='n'>no</p><p hidden>no</p>yes", "yes"),
        ("<div style='display: none'>a</div><div style='visibility:hidden'>b<b style='visibility:visible'>c</b></div>", "c"),
        ("<details><summary>s</summary>more</details><details open><summary>t</summary>more</details>", "s\nt\nmore"),
        ("<!-- c --><b>bold<i>both</b>rest", "boldbothrest"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<p>x</p></div></p>y", "x\n\ny"),
        ("<div>" * 300 + "ok<script>var secret=1</script><span hidden>HID</span><style>.x{display:none}</style>", "ok"),
        ("<style>.a{visibility:hidden}</style><p class=a>no</p>y", "y"),
        ("<style>@media print{.a{display:none}}</style><p class=a>yes</p>y", "yes\n\ny"),
        ("<style>div .a{display:none}</style><p class=a>yes</p><div><p><b class=a>no</b></p></div>", "yes"),
        ("<style>div > .a{display:none} .b{display:none}.b.c{display:block}</style><div><p><b class=a>yes</b></p><i class=a>no</i></div><p class='b'>no</p><p class='b c'>yes", "yes\n\nyes"),
        ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        ("<p hidden style='display:block'>yes", "yes"),
        ("<style>@media screen and (max-width: 600px){p{display:none}}@media (min-width:600px){i{display:none}}</style><p>yes<i>no</i>", "yes"),
    ],
)
def test_rendering(html, text):
    assert html_render.render(html) == text


def test_rendering_of_awkward_pages(spark):
    deep = "<div>" * 50_000 + "deep"
    pages = spark.createDataFrame([(1, None), (2, ""), (3, deep), (3, deep), (None, "<p>x"), (5, "<table><tr><td>" * 300 + "in"), (6, "<" * 1000), (7, "&#x0; &bogus; \ud83d".encode("utf-8", "ignore").decode())], "page_id long, html string").withColumn("text", F.lit(1))
    rows = html_render.render_pages(pages).collect()
    assert len(rows) == 8
    assert sorted(r.text for r in rows if r.page_id == 3) == ["deep", "deep"]
    assert [r.text for r in rows if r.page_id == 5] == ["in"]
    assert html_render.render_pages(pages.limit(0)).count() == 0


def test_every_word_outside_hidden_elements_is_rendered(spark, sf):
    """Against a plain strip of tags: the same words in the same order."""
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"(?is)<(head|script|style|template|noscript)\b.*?</\1>|<!--.*?-->", "", r.html)
        import html as entities

        plain = entities.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        shown = [w for w in html_render.render(r.html).split() if w != "-" and not re.fullmatch(r"\d+\.", w)]
        assert "".join(w for w in plain if w != "-" and not re.fullmatch(r"\d+\.", w)) == "".join(shown)


def test_licences(spark):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/code.txt", "nothing here"),
        ("a/b/own.txt", "text\nReleased under the MIT License.\nmore"),
        ("a/b/own.txt", "text\nReleased under the MIT License.\nmore"),
        ("d/COPYING", "some words of a licence that nobody knows"),
        ("d/x.txt", "none"),
        ("e.txt", None),
        (None, "Licensed under CC BY 4.0."),
        ("a/b/empty", ""),
        ("ab/x", "not under directory a"),
        ("f/g/UNLICENSE", "This is free and unencumbered software released into the public domain."),
        ("f/g/LICENSE", "Licensed under CC BY-NC 4.0."),
        ("f/g/h", "x"),
        ("long", "word " * 200_000 + "\nLicensed under CC BY-SA 4.0."),
    ]
    frame = spark.createDataFrame(files, "path string, text string").withColumn("licence", F.lit("clash"))
    rows = sorted(((r.path or "", r.licence, r.basis, r.licence_dir) for r in licenses.scan(frame).collect()), key=str)
    assert rows == sorted(
        [
            ("a/LICENSE", "Apache-2.0", "own", None),
            ("a/b/c/code.txt", "Apache-2.0", "inherited", "a"),
            ("a/b/own.txt", "MIT", "own", None),
            ("a/b/own.txt", "MIT", "own", None),
            ("d/COPYING", None, "none", None),
            ("d/x.txt", None, "none", None),
            ("e.txt", None, "none", None),
            ("", "CC-BY-4.0", "own", None),
            ("a/b/empty", "Apache-2.0", "inherited", "a"),
            ("ab/x", None, "none", None),
            ("f/g/UNLICENSE", "Unlicense", "own", None),
            ("f/g/LICENSE", "CC-BY-NC-4.0", "own", None),
            ("f/g/h", "CC-BY-NC-4.0", "inherited", "f/g"),
            ("long", "CC-BY-SA-4.0", "own", None),
        ],
        key=str,
    )
    assert licenses.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    rows = queries.queries()[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in rows.collect()))) == sorted(map(str, found.fetchall()))


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""


def test_wrapped_headers_full_texts_and_rows_of_one_path(spark):
    head = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n" + "other words of the long text that follow here\n" * 300
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    rows = [("a/x.py", "#!/usr/bin/python\n" + GPL + "\nimport os", 1), ("b/COPYING", head, 2), ("b/c/y", "none", 3), ("d/LICENSE", bsd, None), ("e/same", "Licensed under CC BY 4.0.", 5), ("e/same", "Released under the MIT License.", 6), ("e/same", "neither", 7)]
    frame = spark.createDataFrame(rows, "path string, text string, doc_id long")
    found = sorted(((r.path, r.licence, r.basis, r.doc_id) for r in licenses.scan(frame, keep=("doc_id",)).collect()), key=str)
    assert found == sorted([("a/x.py", "GPL-3.0", "own", 1), ("b/COPYING", "GPL-3.0", "own", 2), ("b/c/y", "GPL-3.0", "inherited", 3), ("d/LICENSE", "BSD-3-Clause", "own", None), ("e/same", "CC-BY-4.0", "own", 5), ("e/same", "MIT", "own", 6), ("e/same", None, "none", 7)], key=str)


COLUMNS = {
    "op1_licenses": "path licence score basis licence_dir doc_id", "op2_decontaminate": "doc_id item_id start score", "op3_langid": "doc_id held_out lang_pred score", "op4_quality": "doc_id held_out score predicted",
    "op5_pseudo_lm": "doc_id n_words log_prob mean_log_prob", "op6_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op7_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_html": "page_id text", "op9_mixing": "doc_id size source_size target taken", "op10_simhash": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_query_covers_its_table(spark, sf, name):
    rows = queries.queries()[name](spark, sf)
    assert rows.columns == COLUMNS[name].split()
    found = rows.collect()
    if name in ("op2_decontaminate", "op7_chat"):
        assert found
        return
    table, key = ("pages", "page_id") if name == "op8_html" else ("documents", "doc_id")
    assert sorted(r[key] for r in found) == sorted(r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").collect())


def test_pipeline_equals_a_plain_version_of_every_stage(spark, sf):
    """Scores from the fitted models row by row, shingle sets and alignments of every pair, and the mix in SQL."""
    import pyarrow as pa
    from test_text_operators import brute_components, plain_alignment, plain_features, plain_languages  # noqa: F401

    from tideline.llm import decontaminate, langid, quality
    from tideline.llm.text import word_lists

    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    rows = docs.collect()
    x = np.array([plain_features(r.text) for r in rows]).astype(np.float16)
    g = np.column_stack([np.clip((x - model.mean) / model.scale, -5, 5), np.ones(len(x))]) @ model.weights
    rows = [r for r, v in zip(rows, g) if 1 / (1 + np.exp(-v)) >= quality.THRESHOLD]
    kept = spark.createDataFrame(rows, docs.schema)
    languages = langid.fit(kept.where(~langid.held_out()))
    rows = [r for r, (lang, score) in zip(rows, plain_languages([r.text for r in rows], languages)) if lang != "und" and score >= corpus_pipeline.SURE]

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = [r for r in rows if root(r.doc_id) == r.doc_id]

    def ids(texts):
        flat, counts = word_lists(pa.array(texts))
        return np.split(np.array([hash(w) % (1 << 31) for w in flat.to_pylist()]), np.cumsum(counts)[:-1])

    items, texts = ids([r.text for r in bench.collect()]), ids([r.text for r in rows])
    leaking = [any(decontaminate.align(items, [t] * len(items)) >= decontaminate.THRESHOLD * decontaminate.MATCH * np.array([len(i) for i in items])) for t in texts]
    rows = [r for r, leaks in zip(rows, leaking) if not leaks]
    db = duckdb.connect()
    db.register("documents", pa.table({c: [r[c] for r in rows] for c in ("doc_id", "text", "source")}))
    found = db.execute(mixing.MIX_SQL)
    names = [c[0] for c in found.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in corpus_pipeline.run(spark, sf).collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline_stages_act_on_what_came_before(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.first()
    docs = docs.unionByName(spark.createDataFrame([(10**9, first.text, first.lang, first.source, first.n_chars), (10**9 + 1, None, None, None, None)], docs.schema))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id").distinct()
        docs = stage(spark, docs, sf)
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name != "mixing":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "dedup":
            assert docs.where("doc_id = 1000000000").count() == 0
    assert docs.count() > 50 and corpus_pipeline.run(spark, sf).count() > 50


def test_pipeline_stages_take_empty_tables_and_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumns({c: F.lit("clash") for c in ("score", "predicted", "lang_pred", "fp", "size", "row_key", "c0", "r1", "keep_id")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, wide.where("doc_id < 40"), sf)
        assert out.count() > 0 and (name == "mixing" or out.columns == wide.columns)


def test_eleven_queries_are_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
