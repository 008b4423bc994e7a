"""The byte-context trie against a plain one, text by text and byte by byte."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from frames import DOCS, clashing, frame, hard_rows

from opswell.llm import ppm, queries


def is_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each row (doc_id, text)."""
    texts = [(d, (t or "").encode().lower()) for d, t in rows]
    seen, words = defaultdict(Counter), Counter()
    padded = lambda t: ppm.BEFORE * ppm.ORDER + t + ppm.END
    for d, t in texts:
        if not is_out(d):
            words.update([*t.split(), b""])
            b = padded(t)
            for i in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    seen[b[i - k : i]][b[i]] += 1
    total, kinds = sum(words.values()), len(words)
    out = []
    for d, t in texts:
        own, b, log = [*t.split(), b""], padded(t), 0.0
        for i in range(ppm.ORDER, len(b)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                live = {s: n for s, n in seen.get(b[i - k : i], {}).items() if s not in excluded}
                if not live:
                    continue
                n = sum(live.values()) + len(live)
                if b[i] in live:
                    log += math.log10(live[b[i]] / n)
                    break
                log += math.log10(len(live) / n)
                excluded |= set(live)
            else:
                log -= math.log10(256 - len(excluded))
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own)
        out.append((d, is_out(d), len(own), sum(words[w] > 0 for w in own), total, base, log))
    return out


def check(spark, rows, **how):
    found = ppm.score(frame(spark, rows), **how)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: tuple((x is not None, x or 0) for x in r[:4]) + (round(r[6], 6),)
    got, want = sorted((tuple(r) for r in found.collect()), key=key), sorted(plain([r[:2] for r in rows]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize("part", [ppm.PART, 100, 7])
def test_equals_a_plain_trie(spark, part):
    r = random.Random(part)
    word = lambda: "".join(r.choice("abéX.") for _ in range(r.randint(1, 6)))
    rows = [(i, r.choice([" ", "\n", " \t"]).join(word() for _ in range(r.randint(0, 40))), "en", "s", 0) for i in range(60)]
    check(spark, rows + [(1, None, None, None, None), (2, " lead and trail ", "en", "s", 0)], part=part, group=3 * part)


def test_hard_rows(spark):
    rows = hard_rows()
    rows = [(d, t if t is None or len(t) < 20_000 else t[:20_000], *rest) for d, t, *rest in rows]
    check(spark, [*rows, (9, "w" * 65 + " " + "w" * 64 + " " + "w" * 300, "en", "s", 0)], part=5000)


def test_nothing_to_learn_from_and_empty_tables(spark):
    held = [i for i in range(200) if is_out(i)][:3]
    check(spark, [(held[0], "some Text", "en", "s", 9), (held[1], None, "en", "s", 0)])
    assert ppm.score(frame(spark, [(1, "x", "en", "s", 1)]).limit(0)).count() == 0


def test_other_columns_and_a_text_over_many_parts(spark):
    text = " ".join(f"w{i % 100}" for i in range(30_000))
    one, many = (ppm.score(clashing(frame(spark, [(0, text, "en", "s", 0)])), part=p).first() for p in (ppm.PART, 4096))
    assert one[:5] == many[:5] and one.score == pytest.approx(many.score) and one.base_score == pytest.approx(many.base_score)


def test_held_out_texts_of_the_corpus_are_likelier_than_noise(spark, tables):
    rows = queries.QUERIES["op13_ppm_scoring"](spark, tables.folder)
    assert rows.count() == tables.documents.count()
    r = random.Random(4)
    noise = next(i for i in range(10**6, 10**7) if is_out(i))
    docs = tables.documents.select("doc_id", "text").union(spark.createDataFrame([(noise, "".join(chr(r.randrange(33, 127)) for _ in range(2000)))], "doc_id long, text string"))
    scored = ppm.score(docs).join(docs, "doc_id").filter("held_out").selectExpr("doc_id", "score / (coalesce(octet_length(text), 0) + 1) AS per_byte")
    assert scored.orderBy("per_byte").first().doc_id == noise
