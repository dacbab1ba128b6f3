"""Each stage of the pipeline against a plain version on the stage's own input, with nulls, repeated rows and odd texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import corpus_pipeline as pipeline
from motionspark.llm import decontam, pii, quality, tokens
from motionspark.llm.storage import saved

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "né", "ru", "so") for b in ("ba", "den", "fi", "gor", "hul") for c in ("x", "st", "m")]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly_good(docs: list[dict], labels: dict[int, tuple[int, int]]) -> list[bool]:
    raw, good = Counter(), Counter()
    grams = []
    for d in docs:
        b = (d["text"] or "").encode()
        grams.append([(int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(b) - 3)])
        raw.update(grams[-1])
        if labels.get(d["doc_id"]) == (1, 0):
            good.update(grams[-1])
    log = lambda c: {k: math.log((c[k] + quality.SMOOTH) / (c.total() + quality.SMOOTH * quality.BUCKETS)) for k in raw}
    high, low = log(good), log(raw)
    out = []
    for d, g in zip(docs, grams, strict=True):
        found = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        runs = Counter(zip(found, found[1:], found[2:], strict=False))
        repeated = {i + k for i, r in enumerate(zip(found, found[1:], found[2:], strict=False)) if runs[r] > 1 for k in range(3)}
        failed = len(found) < 50 or 100 * len(repeated) > 50 * len(found)
        score = sum(round((high[x] - low[x]) * quality.SCALE) for x in g) / (quality.SCALE * max(1, len(g))) if good else 0.0
        out.append(not failed and score >= quality.LEAST_SCORE)
    return out


def plain_classes(docs: list[dict]) -> dict[int, int]:
    bag = lambda w: Counter([tuple(w)] if 0 < len(w) < 5 else zip(*(w[i:] for i in range(5)), strict=False))
    rows = [(d["doc_id"], bag(words_of(d["text"]))) for d in docs if d["doc_id"] is not None]
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if 10 * (a & b).total() >= 8 * (a | b).total() and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def leaks(text: str | None, item: str) -> bool:
    doc, want = words_of(text), words_of(item)
    size = min(len(want), decontam.STRETCH)
    return any(sum(a == b for a, b in zip(doc[i : i + size], want[k : k + size], strict=False)) >= math.ceil(decontam.AGREE * size) for i in range(len(doc) - size + 1) for k in range(len(want) - size + 1))


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(11)
    item = text_of(rng, 20)
    texts = [text_of(rng, rng.randrange(20, 160)) for _ in range(40)]
    texts += [t + " extra" for t in texts[:6]] + texts[6:10] + [f"{text_of(rng, 60)} {item} {text_of(rng, 60)}", f"{text_of(rng, 60)} {item.upper()}"]
    texts += [f"{text_of(rng, 60)} mail ann@example.org from 10.0.0.1, call +49 30 1234 5678", "spam spam spam " * 40, "#### $$$$ %%%% " * 30, "".join(rng.choice("qxzjw#$%") + " " for _ in range(300)), "", " \n", None]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (3, text_of(rng, 90), None, None, None), (None, text_of(rng, 90), "en", "web", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = {i: (int(i < 30), 0) for i in range(48)}
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, *v) for i, v in labels.items()], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "one two"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda d: str(sorted(d.items()))
    before = [r.asDict() for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        after = [r.asDict() for r in docs.collect()]
        if name == "quality_rules":
            want = [d for d, ok in zip(before, plainly_good(before, labels), strict=True) if ok]
            assert 40 < len(want) < len(before)
        elif name == "near_duplicates":
            # rows of one id are one document, of which any row may stay
            label = plain_classes(before)
            heads = {i for i, c in label.items() if i == c}
            want = [d for d in before if d["doc_id"] is None or d["doc_id"] in heads]
            ids = [d["doc_id"] for d in after if d["doc_id"] is not None]
            assert sorted(ids) == sorted(heads)
            assert len(heads) < len(label)
            assert all(d in want for d in after)
            want = after
        elif name == "decontamination":
            want = [d for d in before if not leaks(d["text"], item)]
            assert len(want) < len(before)
        else:
            found = {}
            for r in pii.find_spans(spark.createDataFrame([tuple(d.values()) for d in before], schema)).collect():
                d = r.asDict()
                spans = d.pop("pii_spans")
                found[key(d)] = spans
            want = []
            for d in before:
                out, at = "", 0
                for s in found[key(d)]:
                    if s["start"] >= at:
                        out += d["text"][at : s["start"]] + f"[{list(pii.PATTERNS)[s['rank']].upper()}]"
                    at = max(at, s["end"])
                whole = None if d["text"] is None else out + d["text"][at:]
                want.append(d | {"text": whole, "n_chars": None if whole is None else len(whole)})
            assert any("[EMAIL]" in (d["text"] or "") for d in want)
        assert sorted(map(key, after)) == sorted(map(key, want)), name
        before = after
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    sizes = [len(x) // 4 + 1 for x in tokens.encoder(tokens.default_path()).encode([d["text"] for d in before])]
    assert packed["length"].sum() == sum(sizes)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed["sequence_id"].nunique() == -(-sum(sizes) // 2048)
