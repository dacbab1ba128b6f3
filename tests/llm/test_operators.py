"""The ten text operators against brute force, round trips and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from motionspark.llm import chat, decontam, licenses, neardup, packing, pages, pii, pseudo, quality, sstable, tokens

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ru", "so", "ta", "vü") for b in ("ba", "den", "fi", "gor", "hul", "jas", "kem", "lor", "nu", "pit")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def table(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(texts), schema)


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 200_000), (6, "tie tie tie"), (6, "tie tie tie"), (7, "日本語 テキスト  ümlaut\n\nß"), (8, "a b " * 30_000), (None, "no id")]


# 1: pages

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>Fish &amp; chips</h1><p>First   paragraph with <b>bold</b>
text that goes on for a while, long enough.</p><p>Second &eacute;t&#233; paragraph, which is long as well.</p></article>
<div id="comments"><p>Nice post!</p></div><footer>Copyright</footer></body></html>"""


def test_main_text_of_a_page():
    assert pages.main_text(PAGE) == "Fish & chips\n\nFirst paragraph with bold text that goes on for a while, long enough.\n\nSecond été paragraph, which is long as well."


def test_clusters_choose_the_lines_of_a_page():
    body = [f"Paragraph {i} " + "of the main text, which goes on for quite a while. " * 4 for i in range(8)]
    div = "".join(f"<p>{t}</p>" for t in body)
    want = [t.strip() for t in body]
    cards = "".join(f"<article><h3><a href='/{i}'>Card {i}</a></h3><p><a href='/{i}'>More about {i}</a></p></article>" for i in range(4))
    assert pages.main_text(f"<body><div>{div}</div><div>{cards}</div></body>").split("\n\n") == want
    links = "<p><a href='/t'>Tweet</a> <a href='/s'>Share this</a></p>"
    notices = "<p><b>Sign</b> <i>up</i> <u>now</u></p>" * 8
    got = pages.main_text(f"<body><article>{links}<h1><a href='#t'>Title</a></h1>{div}<p>Short.</p>{links}<h2>More</h2><p>{body[0]}</p><p>The end.</p>{notices}</article></body>").split("\n\n")
    assert got[:12] == ["Title", *want, "Short.", "More", want[0]]
    assert got[12] == "The end."
    assert len(got) <= 13 + 6  # smoothing reaches six lines


@pytest.mark.parametrize("tag", ["span", "font", "div", "b"])
def test_many_unclosed_tags_end_with_the_element_around_them(tag):
    text = "The main text, which goes on for quite a while and then ends. " * 3
    page = f"<body><div class='ad'><section>{f'<{tag}>spam ' * 400}</section></div><article><p>{text}</p></article><p>{'Outside. ' * 2}</p></body>"
    got = pages.main_text(page)
    assert "spam" not in got
    assert got.startswith(text.strip())
    inside = pages.Lines()
    inside.feed(f"<article>{f'<{tag}>' * 400}{text}</article><p>after</p>")
    assert [line.inside for line, *_ in inside.finish()] == [True, False]


def test_stray_end_tags_take_no_time_with_depth():
    import time

    page = "<b><div>" + "<font>" * 20_000 + "</b></li>" * 20_000 + "word"
    began = time.process_time()
    assert pages.main_text(page) == "word"
    assert time.process_time() - began < 5


def test_pages_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (3, "u", "plain words only"), (4, "u", "<p>open <b>tags <i>everywhere"), (5, "u", "<p>" + "long " * 50_000 + "</p>")]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[:3] == [(1, 0), (2, 0), (3, 16)]
    assert len(got) == 6
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2: personal data


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """The base kinds, found plainly."""
    number = lambda v: re.sub("[^0-9]", "", v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(number(v)) <= 19 and luhn(number(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(number(v)) <= 15),
    }
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) if k != "email" or "@" in text for m in re.finditer(p, text) if ok(m[0])]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_personal_data_against_plain_search(spark, tmp_path):
    rng = random.Random(5)
    parts = ["ann@example.org", "a@b", "x.y@z.co.uk,", "10.0.0.255", "1.2.3.4.5.6", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234.5678", "+1", "12", "é", "ü@ü.de", "@", "..", "5500005555555559", "00012.1.1.1", "-", " ", "\n", "𝒳", "contact", "a.b@c-d.e-f.gh@i.j"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i or 0, t) for i, t in HARD]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op2_personal_data(spark, str(tmp_path)).collect()
    want = sorted((i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want


def test_redaction_keeps_columns_and_iban_needs_mod97(spark):
    docs = table(spark, [(1, "iban DE89370400440532013000 mail a@b.de ok"), (2, "iban DE89370400440532013001"), (3, None)]).selectExpr("*", "1 AS pii_spans_", "'k' AS kind")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "iban [IBAN] mail [EMAIL] ok", 2: "iban DE89370400440532013001", 3: None}
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.limit(0)).count() == 0


# 3: near-duplicates


def runs_of(text: str) -> frozenset:
    found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(found)] if 0 < len(found) < 5 else zip(*(found[i:] for i in range(5)), strict=False))


def plain_classes(docs: list[tuple[int, str]]) -> dict[int, int]:
    label = {i: i for i, _ in docs}

    def top(x: int) -> int:
        return x if label[x] == x else top(label[x])

    sets = [(i, runs_of(t), t or "") for i, t in docs]
    for (i, a, s), (j, b, t) in combinations(sets, 2):
        if (a and b and len(a & b) * 10 >= len(a | b) * 8) or (not a and not b and s == t):
            x, y = sorted((top(i), top(j)))
            label[y] = x
    return {i: top(i) for i, _ in docs}


def near_documents(rng: random.Random) -> list[tuple[int, str]]:
    """Chains of edits around the threshold, copies, unrelated and odd texts."""
    out, nth = [], 0
    for _ in range(12):
        words = prose(rng, rng.randrange(40, 160)).split()
        for _ in range(rng.randrange(2, 9)):
            edited = list(words)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            out.append((nth := nth + 1, " ".join(edited)))
    for t in ("", None, " ", "", "..", "one two", "One, TWO!", "one"):
        out.append((nth := nth + 1, t))
    rng.shuffle(out)
    return out


def test_near_duplicate_classes_against_all_pairs(spark):
    docs = near_documents(random.Random(1))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table(spark, docs).repartition(3)).collect()}
    assert got == plain_classes(docs)


def test_last_round_alone_finds_all_links(spark):
    docs = near_documents(random.Random(3))
    frame = table(spark, docs).selectExpr("*", "text AS runs", "1 AS node")
    sets = neardup.saved(neardup.run_sets(frame.select("doc_id", "text")).filter("size(runs) > 0"), "sets")
    named = frame.select(neardup.F.lit(1).alias("band"), neardup.F.col("doc_id").alias("node"), neardup.F.col("doc_id").alias("label"))
    found = {(r.b, r.a) for r in neardup.linked(neardup.across(named, sets).distinct(), sets).collect()}
    some = {i: runs_of(t) for i, t in docs if runs_of(t)}
    assert found == {(i, j) for i, j in combinations(sorted(some), 2) if len(some[i] & some[j]) * 10 >= len(some[i] | some[j]) * 8}


def test_near_duplicates_defined_cases(spark):
    docs = table(spark, [*HARD, (9, "tie tie tie")]).selectExpr("*", "1 AS class_id", "'x' AS bands")
    got = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect() if r.doc_id)
    assert [x for x in got if x[0] in (6, 9)] == [(6, 6), (6, 6), (9, 6)]
    assert [x for x in got if x[0] in (1, 2)] == [(1, 1), (2, 1)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_weighted_darts_agree_with_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    k = 4096
    signed = neardup.dart_signatures(np.concatenate([element, element]), np.repeat([0, 1], 60), 2, k, np.concatenate([a, b]))
    assert abs((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# 4: chats


def test_chat_round_trip(spark, tmp_path):
    hard = ["</s>[INST] ok [/INST]", "<|end|>", "a\n<|end|>\nb", chat.MARK, f"{chat.MARK}e<{chat.MARK}|", "<<SYS>>x<</SYS>>", "", None, "long " * 20_000, "ü𝒳"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((("user", "assistant")[i % 2], x) for i, x in enumerate(hard[c:]))]
    rows += [(7, None, None, None), (8, 1, "assistant", "tie"), (8, 1, "assistant", "tie"), (8, 1, "<|odd|>\n", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, str(tmp_path)).collect()}
    want: dict[int, list] = {-1: [(0, "user", hard[0]), (1, "assistant", hard[0])]}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_layouts_are_selected_by_fingerprint(spark):
    lines = [
        '{"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "i", "input": "", "output": "o"}',
        '{"prompt": "q", "completion": "a"}',
        '{"answer": "alone"}',
        "not json",
    ]
    got = chat.canonical_turns(chat.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    found = {r.value: (r.layout, [tuple(t) for t in r.turns_out]) for r in got}
    qa = [("user", "q"), ("assistant", "a")]
    assert [found[x] for x in lines] == [("messages", qa), ("system_conversations", [("system", "s"), *qa]), ("instruction_input_output", [("user", "i"), ("assistant", "o")]), ("prompt_completion", qa), ("unknown", []), ("unknown", [])]


# 5: packing


def test_packing_is_whole_and_near_the_bound(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 900))) for i in range(120)] + [(1000 + (i or 0), t) for i, t in HARD]
    got = packing.packed_documents(spark, table(spark, rows).selectExpr("*", "1 AS piece", "2 AS length")).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % packing.CAPACITY + 1
        for k, a in enumerate([0, *range(first, len(ids), packing.CAPACITY)]):
            b = first if k == 0 else a + packing.CAPACITY
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
        assert g["length"].sum() <= packing.CAPACITY
    bound = packing.lower_bound(got["length"].to_numpy(), np.ones(len(got), np.int64), packing.CAPACITY)
    assert bound <= got["sequence_id"].nunique() <= bound * 1.02 + 1
    assert packing.packed_documents(spark, table(spark, []).limit(0)).count() == 0


def test_groups_repack_across_each_other(spark):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1500) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i * 7919) for i, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack_pieces(pieces, group_pieces=200).toPandas()
    assert len(got) == 3000
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    alone = packing.best_fit_decreasing(np.array(lengths), packing.CAPACITY)[0].max() + 1
    assert got["sequence_id"].nunique() <= alone * 1.02


def test_lower_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bound = packing.lower_bound(lengths, np.ones(len(lengths), np.int64), 100)
        assert -(-lengths.sum() // 100) <= bound <= packing.best_fit_decreasing(lengths, 100)[0].max() + 1


# 6: scores


def test_pseudo_likelihood_is_a_distribution_and_learns():
    net = pseudo.Network(pseudo.initial())
    context = np.array([[3], [4], [5], [6]], np.int16)
    every = np.arange(pseudo.CLASSES)
    assert abs(np.exp(net.log_likelihood(every, np.repeat(context, pseudo.CLASSES, 1))).sum() - 1) < 1e-4
    rng = np.random.default_rng(0)
    cycle = np.tile(rng.permutation(40) * 7, 400)
    around = pseudo.windows(cycle, np.zeros(len(cycle), np.int64))
    before = net.log_likelihood(cycle, around).mean()
    for _ in range(10):
        net.train(cycle, around)
    shuffled = rng.permutation(cycle)
    after, odd = net.log_likelihood(cycle, around).mean(), net.log_likelihood(shuffled, pseudo.windows(shuffled, np.zeros(len(cycle), np.int64))).mean()
    assert after > before + 1
    assert after > odd + 1


def test_scores_defined_cases(spark):
    rng = random.Random(4)
    sentence = prose(rng, 30)
    rows = [(100 + i, sentence) for i in range(60)] + HARD
    got = {r.doc_id: r for r in pseudo.score_documents(table(spark, rows).selectExpr("*", "1 AS score", "2 AS n_words")).collect()}
    assert (got[1].n_words, got[1].pll, got[1].score) == (0, 0.0, None)
    assert got[3].score is None
    assert abs(got[100].pll / got[100].n_words - got[100].score) < 1e-9
    assert got[100].n_words == 30
    assert pseudo.score_documents(table(spark, []).limit(0)).count() == 0


# 7: decontamination


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 40)) for i in range(20)] + [(50, "six plain words stand right here"), (51, None), (52, "too short"), (None, prose(rng, 30))]
    docs, want = [], set()
    for i in range(60):
        body, item = prose(rng, 120).split(), i % 20
        if i < 40:
            passage = items[item][1].split()
            for k in range(i % 4):  # up to three words are changed
                passage[5 + 12 * k] = "changed"
            body[30:30] = passage
            want.add((i, item))
        docs.append((i, " ".join(body)))
    docs.append((99, "so SIX, plain words; stand right here."))
    want.add((99, 50))
    got = decontam.find_leaks(table(spark, [*docs, *HARD[1:4], (None, None)]).selectExpr("*", "1 AS words", "2 AS at"), table(spark, items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    frame = table(spark, docs).selectExpr("*", "1 AS item_id", "'x' AS hash")
    clean = decontam.keep_clean(frame, table(spark, items, "item_id long, text string"))
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == set(range(40, 60))
    empty = table(spark, items, "item_id long, text string").limit(0)
    assert decontam.keep_clean(frame, empty).count() == len(docs)
    assert decontam.find_leaks(frame.limit(0), empty).count() == 0


# 8: licenses


def test_base_phrases_against_plain_search(spark):
    rng = random.Random(8)
    parts = ["cc by", "CC-BY", "general public license", "General Public\nLicense", "all rights reserved", "cc", "by", "all", "rights", "ü", "public", "license", "Licensed under the Apache License, Version 2.0", "MIT License"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(100, 180)] + HARD
    got = licenses.scan_licenses(table(spark, rows).selectExpr("*", "1 AS labels", "2 AS spans")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for label, phrase in licenses.PHRASES.items() for k in range(len(found)) if tuple(found[k : k + len(phrase)]) == phrase]
        r = by_id[i]
        assert (r.n_words, r.n_base) == (len(found), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_contained_detections_give_way():
    text = "licensed under the apache license, version 2.0 and the gnu general public license v3.0"
    got = licenses.detections(text, list(range(len(licenses.rules()))))
    assert {licenses.rules()[n].label for _, _, n in got} == {"apache-2.0", "gpl-3.0"}
    many = " ".join([text] * 150)
    assert len(licenses.detections(many, list(range(len(licenses.rules()))))) == 150 * len(got)
    plain = "an artistic license, elastic boost software for python 3, php 3.0, an open database and unicode 3.0"
    assert {licenses.rules()[n].label for _, _, n in licenses.detections(plain, list(range(len(licenses.rules()))))} == {"artistic"}
    assert len(licenses.rules()) > 200


def shortest(tree) -> str:
    """A least text that a parsed pattern matches; of each branch the first."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "e"
        elif name == "IN":
            kind, x = arg[0]
            out += {"LITERAL": lambda: chr(x), "RANGE": lambda: chr(x[0]), "CATEGORY": lambda: "\n"}[str(kind)]()
        elif name == "MAX_REPEAT":
            out += shortest(arg[2]) * arg[0]
        elif name == "SUBPATTERN":
            out += shortest(arg[3])
        elif name == "BRANCH":
            out += shortest(arg[1][0])
    return out


def test_each_license_rule_fires_on_its_own_match():
    for n, rule in enumerate(licenses.rules()):
        text = shortest(re._parser.parse(rule.pattern.pattern))
        for around in (text, f"“{text}”", f"x\n\n{text}\n\nx"):
            assert rule.pattern.search(around), (rule, around)
            assert n in licenses.candidates(around.encode()), (rule, around)


@pytest.mark.parametrize(
    ("text", "label"),
    [("under CDDL-1.0", "cddl-1.0"), ("EUPL-1.2", "eupl-1.2"), ("SSPL-1.0", "sspl-1.0"), ("under LGPLv3", "lgpl-3.0"), ("AGPLv3", "agpl-3.0"), ("gpl3", "gpl-3.0"), ("LGPL3", "lgpl-3.0"), ("FreeBSD License", "bsd-2-clause"), ("the Open Data License 1.0", "odbl-1.0"), ("both MIT licences: MIT licence", "mit"), ("“MIT License”", "mit"), ("GNU  General\n    Public\tLicense v3", "gpl-3.0"), ("All Rights\n\nReserved", "reserved")],
)
def test_license_scan_finds(text, label):
    import pyarrow as pa

    from motionspark.llm.words import slices

    (part,) = slices(pa.array([text]))
    assert label in licenses.scan(part)[0]["labels"].split(",")


def test_candidates_leave_no_match_out():
    rng = random.Random(88)
    bits = ["gpl", "lgpl", "v", "3", ".0", "-", " ", "\n", "mit", "license", "licence", "open", "data", "cc", "by", "sa", "4.0", "bsd", "free", "new", "public", "creative commons", "attribution", "epl", "people", "apache", "“", "_", "x", "zlib/libpng", "rights reserved", "all", "noncommercial", "domain", "in the"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(2, 12)))
        hit = {n for n, rule in enumerate(licenses.rules()) if rule.pattern.search(text)}
        assert hit <= set(licenses.candidates(text.encode())), text


# 9: quality


def plain_counts(t: str) -> tuple[int, ...]:
    found = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_plain_ones(spark):
    rng = random.Random(10)
    parts = ["a", "b", "é#", "\n", "\n\n", "\t", "  ", "x|y", "<b>", "a b c", " ", "line\n"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))) for i in range(100)] + [(200 + (i or 0), t) for i, t in HARD if i != 8]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality long, toxic long")
    got = quality.judge(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        r, want = by_id[i], plain_counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_ratio_tells_trusted_from_raw(spark):
    rng = random.Random(11)
    good = [(i, prose(rng, 120)) for i in range(40)]
    bad = [(100 + i, " ".join("".join(rng.choice("0123456789#$%") for _ in range(7)) for _ in range(120))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)], "doc_id long, quality long, toxic long")
    docs = table(spark, good + bad).selectExpr("*", "1 AS score", "false AS kept", "2 AS trusted")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in good}
    assert quality.judge(docs, labels.limit(0)).filter("kept").count() == 60  # no trusted rows: all scores are 0
    assert quality.judge(docs.limit(0), labels).count() == 0


# 10: shards


def test_shards_give_back_the_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    rows = [(rng.randrange(-50, 5000), prose(rng, rng.randrange(0, 300))) for _ in range(300)] + HARD
    docs = table(spark, rows).selectExpr("*", "1 AS start", "2 AS ids").repartition(5)
    manifest = sstable.write_shards(docs, f"file://{tmp_path}/sst", tokens.default_path())
    got = sstable.read_shards(spark, manifest).orderBy("start").collect()
    tok = Tokenizer.from_file(tokens.default_path())
    ids = {(i, t): np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted(bytes(r.ids) for r in got) == sorted(ids[x] for x in rows)
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got])[:-1]]
    shards = [sstable.ShardReader(r.path) for r in manifest.collect()]
    for i, t in rows[::37]:
        assert ids[i, t] in {x.tobytes() for s in shards for x in s.get(i)}
    assert all(not s.get(10**9) for s in shards)
    assert sstable.token_shards(spark, docs.limit(0)).count() == 0


def test_chunked_encoding_equals_whole_texts():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokens.default_path()), random.Random(13)
    parts = [" ", "  ", "\n", "a", "don't", "1,234", "é", "日本", " ", " ", "<|endoftext|>", "Ġ", "x" * 30, "\t", ".", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(tokens.default_path()).encode([*texts, None])]
    assert got == [e.ids for e in tok.encode_batch([*texts, ""], add_special_tokens=False)]


# the pipeline


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = neardup.saved(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and now, name
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == before
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
