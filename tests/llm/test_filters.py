"""Decontamination, url rules, mixing, secrets, personal data, toxicity and the pipeline on small tables."""

from __future__ import annotations

import argparse
import asyncio
import email.message
import hashlib
import http.client
import itertools
import math
import random
import re
import socket
import ssl
import unittest
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pyspark.sql.functions
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollbook.llm import decontaminate, mixing, pii, secrets, toxicity, url_filter
from tests.llm.test_duplicates import ODD, frame, prose

SMALL = "/root/testdata/sf0.001"


def test_decontamination(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 9)), (3, None), (4, "too short"), (None, prose(3, 20)), (1, prose(1, 30))]
    benchmark = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, words int")
    one = prose(1, 30).split()
    swapped = [w if k not in (3, 11, 19, 27) else "other" for k, w in enumerate(one)]
    broken = [w if k % 3 else "other" for k, w in enumerate(one)]
    rows = [
        *ODD,
        (10, f"{prose(50)} {prose(1, 30).upper()}! {prose(51)}"),
        (11, " ".join([*prose(52).split(), *swapped])),
        (12, " ".join(broken)),
        (13, prose(2, 9)),
        (14, " ".join(prose(2, 9).split()[:8])),
        (15, prose(53) + ", " + ", ".join(one[5:20])),
        (16, prose(3, 20)),
        (None, prose(2, 9)),
        (13, prose(2, 9)),
    ]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id, r.word_start, r.word_end, r.matched) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(10, 1, 120, 150, 30), (11, 1, 120, 150, 26), (13, 2, 0, 9, 9), (15, 1, 120, 135, 15), (16, None, 0, 20, 20), (None, 2, 0, 9, 9)}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([r[0] for r in ODD] + [12, 14], key=str)
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize(("size", "replaced"), [(8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2)])
def test_some_mask_fits_between_replaced_words(size, replaced):
    masks = decontaminate.MASKS[max(n for n in decontaminate.MASKS if n <= size)]
    placed = [{k + p for k, used in enumerate(mask) if used == "1"} for mask in masks for p in range(size - len(mask) + 1)]
    for gone in itertools.combinations(range(size), replaced):
        assert any(not at & set(gone) for at in placed)


def overlaps_by_brute_force(docs, items, window=13):
    """Every item laid over every text at every shift."""
    code, found = {}, set()
    parts = lambda text: np.array([code.setdefault(w, len(code)) for w in re.findall(r"[^\W_]+", (text or "").lower())], int)
    items = [(item_id, parts(text)) for item_id, text in items]
    for doc_id, text in docs:
        words = parts(text)
        for item_id, item in items:
            n, span = len(item), min(window, len(item))
            if n == 0 or n < 4 and words.tolist() != item.tolist():
                continue
            around = np.full(n, -1)
            laid = np.lib.stride_tricks.sliding_window_view(np.concatenate([around, words, around]), n)
            sums = np.cumsum(np.pad(laid == item, ((0, 0), (1, 0))), axis=1)
            outside = np.cumsum(np.pad(laid == -1, ((0, 0), (1, 0))), axis=1)
            good = (sums[:, span:] - sums[:, :-span] >= (span if n < 8 else 0.8 * span)) & (outside[:, span:] == outside[:, :-span])
            for row in np.flatnonzero(good.any(axis=1)):
                places = np.flatnonzero(good[row])
                equal = [k for k in range(places[0], places[-1] + span) if laid[row, k] == item[k]]
                found.add((doc_id, item_id, row - n + equal[0], row - n + equal[-1] + 1, int(sums[row, equal[-1] + 1] - sums[row, equal[0]])))
    return found


def test_decontamination_equals_brute_force(spark):
    chance = random.Random(11)
    items = [(n, prose(700 + n, n)) for n in range(1, 31)] + [(100, "What is the capital of France?"), (101, prose(7, 400)), (102, None), (103, "")]
    docs = []
    for k in range(400):
        words = chance.choice(items[:32])[1].split()
        begin = chance.randrange(len(words))
        words = words[begin:] if chance.random() < 0.2 else words
        for _ in range(chance.randint(0, 4)):
            words[chance.randrange(len(words))] = "other"
        docs.append((k, " ".join([prose(1000 + k, chance.choice([0, 1, 63, 64, 130])), *words, prose(2000 + k, chance.choice([0, 3, 70]))])))
    docs += [(500, "so: what is the capital of france, then"), (501, prose(701, 1)), (502, prose(702, 2) + " more"), (503, prose(3000, 250_000) + " " + prose(7, 400)), *ODD]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.word_start, r.word_end, r.matched) for r in decontaminate.contaminated(frame(spark, docs), benchmark).collect()]
    few = [d for d in docs if d[0] != 503]
    wanted = overlaps_by_brute_force(few, items) | {(503, 101, 250_000, 250_400, 400)}
    assert set(got) == wanted and len(got) == len(wanted) > 200


def test_decontamination_of_the_documents_equals_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    items = [(d["item_id"], d["text"]) for d in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    found = decontaminate.contaminated(*(spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark")))
    assert {(r.doc_id, r.item_id, r.word_start, r.word_end, r.matched) for r in found.collect()} == overlaps_by_brute_force(docs, items)


def test_url_rules(spark):
    rules = [url_filter.site_rule("allow", "com/"), url_filter.site_rule("block", "example.com/en/"), url_filter.site_rule("block", "a.b/x")]
    rules.append(url_filter.word_rule("block", "casino", r"^[^#]*casino-[^#]*#", ("casino",)))
    urls = {
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://m.example.com/EN/1?q#f": ("m.example.com", "/EN/1", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?x=/en/": ("example.com", "", None, "allow"),
        "ftp://casino-win.org/": ("casino-win.org", "/", None, "block"),
        "http://a.b/xyz": ("a.b", "/xyz", "a.b/x", "block"),
        "example.com/en/": ("", "", None, "allow"),
        "http://É.com/é": ("É.com", "/é", "com/", "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, url) for k, url in enumerate(urls)] + [(None, "http://a.b/x"), (0, "http://a.b/x")]
    pages = spark.createDataFrame([(*r, "", 0) for r in rows], "page_id long, url string, host string, token int")
    got = [tuple(r) for r in url_filter.judge_urls(pages, rules).collect()]
    wanted = [(k, *urls[url]) if url in urls else (k, "a.b", "/x", "a.b/x", "block") for k, url in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.site_rule("block", "-/")


def test_mix(spark):
    chance = random.Random(1)
    rows = [*[(i, t, "en", "a") for i, t in ODD], *[(100 + k, prose(k, chance.randint(1, 40)), "en", chance.choice(["a", "b", "é", None])) for k in range(300)]]
    rows += [(500, "same words here", "en", "b")] * 50
    docs = frame(spark, rows)
    first = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert first[order].sort_values(order).values.tolist().__str__() == again[order].sort_values(order).values.tolist().__str__()
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    assert len(first) == len(rows) and (first.taken <= 2 * first["size"]).all()
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target.update({s: weight[s] * level for s in open_})
    for s in names:
        part = first[first.source.isnull() if s is None else first.source == s]
        assert part.source_size.unique().tolist() == [sizes[s]]
        assert part.target.unique() == pytest.approx([target[s]])
        assert abs(part.taken.sum() - target[s]) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def known_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark):
    chance = random.Random(3)
    pieces = ["token", "Secret", "API_key", ":", "=", " ", '"', "'", "abcde", "f00", "AKIA", "ABCDEFGH1234", "é", ".", "\n", "0123456789abcdef"]
    rows = [(k, "".join(chance.choices(pieces, k=chance.randint(0, 40)))) for k in range(300)]
    rows += [*ODD, (1000, "a1b2" * 5000), (1001, "token=abcdef " * 700)]
    zero = [0.0] * len(secrets.ALPHABET) ** 2
    found = secrets.scan_secrets(frame(spark, rows), zero).collect()
    for row in found:
        assert [(s.start, s.order, s.end, s.kind) for s in row.spans] == known_secrets(row.text)


def test_random_keys_are_told_from_identifiers(spark):
    chance = random.Random(5)
    key = lambda n: "".join(chance.choices(secrets.ALPHABET[:62], k=n))
    rows = [(k, f"{prose(k, 30)} {'_'.join(prose(900 + k, 3).split())} token = {key(40)}") for k in range(80)]
    docs = frame(spark, [*rows, (500, f"see {key(44)} here"), (501, "see " + "_".join(prose(77, 5).split()) + " here"), *ODD])
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect() if r.doc_id in (500, 501)}
    assert got[500].spans == "random:4:48" and got[501].spans == "" and got[500].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[500] == "see [RANDOM] here" and texts[50].endswith("[ASSIGN]") and len(texts) == 83
    assert secrets.secret_report(docs.limit(0)).count() == 0
    assert secrets.secret_report(frame(spark, ODD)).where("spans = ''").count() == len(ODD)


def test_keys_of_all_alphabets_are_found_and_names_are_not(spark):
    chance = random.Random(12)
    letters = secrets.ALPHABET
    sets = [letters[:62], letters[:64], letters[:26] + "234567", letters[26:62], letters[:26] + letters[52:62]]
    keys = [(a, n, "".join(chance.choices(letters_of, k=n))) for a, letters_of in enumerate(sets) for n in (20, 24, 32, 40) for _ in range(100)]
    names = {name for module in (argparse, asyncio, email.message, http.client, pyspark.sql.functions, socket, ssl, unittest) for name in dir(module)}
    names |= {name for module in (unittest.TestCase, http.client.HTTPConnection, argparse.ArgumentParser) for name in dir(module)}
    names = {n for n in names if len(n) >= 20} | {f"usr/local/{'/'.join(prose(k, 3).split())}" for k in range(100)} | {f"backup-20{k}-0{k % 9 + 1}-1{k % 9}-daily" for k in range(10, 99)}
    rows = [(k, f"see {value} here", None, str(key[:2])) for k, (*key, value) in enumerate(keys)] + [(10_000 + k, f"see {n} here", None, "name") for k, n in enumerate(sorted(names))]
    ratios, least = secrets.fit(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    found = secrets.scan_secrets(frame(spark, rows), ratios, least=least).select("source", secrets.F.size("spans").alias("n")).toPandas()
    share = (found.n > 0).groupby(found.source).mean()
    assert share["name"] <= 0.01 and share.drop("name").min() >= 0.9 and len(names) > 200


def test_personal_data_in_other_forms_is_found_and_ordinary_numbers_are_not(spark):
    chance = random.Random(13)
    d = lambda n: "".join(chance.choices("0123456789", k=n))
    ordinary = [
        lambda: f"{chance.randint(1900, 2030)}-{chance.randint(1, 12):02}-{chance.randint(1, 28):02}",
        lambda: f"{chance.randint(1, 28)}.{chance.randint(1, 12)}.{chance.randint(1900, 2030)}",
        lambda: f"{d(4)}-{d(4)}-{d(3)}",
        lambda: f"978-3-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{d(2)}.{d(3)}.{d(3)}",
        lambda: f"10.2.{d(2)}.{d(4)}",
        lambda: f"{chance.randint(1800, 1950)}-{chance.randint(1951, 2020)}",
        lambda: f"{d(3)}-{d(3)} {d(3)}-{d(3)}",
        lambda: f"4111 1111 1111 111{chance.choice('023456789')}",
        lambda: d(9),
    ]
    personal = [lambda: f"bob{d(2)} (at) example.org", lambda: f"ann.{d(1)}[at]mail.example.com", lambda: f"({d(3)}) {d(3)}-{d(4)}"]
    forms = [(0, make()) for make in ordinary for _ in range(100)] + [(1 + k, make()) for k, make in enumerate(personal) for _ in range(50)]
    rows = [(kind, f"{prose(k, 4)} {chance.choice(['dated', 'see the', 'was'])} {form}{chance.choice([' and', ',', '.', ''])}") for k, (kind, form) in enumerate(forms)]
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    found = pii.find_personal_data(frame(spark, rows), model).select("doc_id", pii.F.size("spans").alias("n")).toPandas()
    share = (found.n > 0).groupby(found.doc_id).mean()
    assert share[0] <= 0.01 and share.drop(0).min() >= 0.9


def known_personal_data(text):
    text = text or ""

    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    number = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    spans += [(m.start(), 1, m.end(), "ip") for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
    spans += [(m.start(), 2, m.end(), "card") for m in cards if 14 <= len(number(m)) <= 19 and luhn(number(m))]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    spans += [(m.start(), 3, m.end(), "phone") for m in phones if 10 <= len(number(m)) <= 15]
    return sorted(spans)


def test_personal_data(spark):
    chance = random.Random(6)
    pieces = [*"ab@@..--  ++()0123456789_%é\n", "1.2.3.4", "4111111111111111", "x@y.zz", "+1 (555) 010-9999"]
    rows = [(k, "".join(chance.choices(pieces, k=chance.randint(0, 50)))) for k in range(500)]
    rows += [*ODD, (1000, "1 " * 20000), (1001, "a" * 50000), (1002, "a@b.cc " * 900), (1003, "1." * 5000)]
    for row in pii.find_personal_data(frame(spark, rows), pii.Model()).collect():
        assert [(s.start, s.order, s.end, s.kind) for s in row.spans] == known_personal_data(row.text)


def test_trees_add_what_looks_like_the_known_forms(spark):
    chance = random.Random(8)

    def card():
        digits = [chance.randint(0, 9) for _ in range(15)]
        total = sum(d * 2 - 9 * (d > 4) if k % 2 == 0 else d for k, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    decoy = lambda: "".join(chance.choices("0123456789", k=16))
    rows = [(k, f"{prose(k, 5)} {card()} {prose(k + 500, 5)} no. {decoy()} {prose(k, 3)}") for k in range(300)]
    first, second = card(), card()
    docs = frame(spark, [*rows, (900, f"both {first} {second} here"), *ODD])
    model = pii.fit(docs, precision=0.9)
    assert "group" in model.thresholds
    got = pii.find_personal_data(docs, model).where("doc_id = 900").first()
    assert {("group", 5, 21), ("group", 22, 38)} <= {(s.kind, s.start, s.end) for s in got.spans} and not got.card
    out = pii.redact(docs)
    assert out.columns == docs.columns and "[CARD]" in out.where("doc_id = 7").first().text
    assert pii.personal_data_report(docs.limit(0)).count() == 0


def test_trees_are_grown_on_all_documents(spark, monkeypatch):
    seen = []

    class Enough(Exception):
        pass

    def counted(source, *_):
        seen.append(source.count())
        raise Enough

    monkeypatch.setattr(pii, "_examples", counted)
    with pytest.raises(Enough):
        pii.fit(frame(spark, [*((k, f"call +385 1 234 {k:04d} now") for k in range(2500)), *((k, "no number") for k in range(9))]))
    assert seen == [2500]


def test_toxicity(spark):
    chance = random.Random(9)

    def text(bad):
        words = prose(chance.random(), chance.randint(5, 80)).split()
        if bad:
            for _ in range(2):
                words.insert(chance.randrange(len(words)), chance.choice(["moronic", "Pathetic!", "trashy", "scumbag"]))
        return " ".join(words)

    rows = [(k, text(k % 4 == 0)) for k in range(900)]
    extra = [(5000, "so pathetik, a moronical scumbags"), (5001, prose(4, 300)), (5002, prose(5, 3000) + " pathetic scumbag " + prose(6, 3000)), *ODD]
    docs = frame(spark, [*rows, *extra])
    marks = [(k, 1, int(k % 4 == 0), 0) for k in range(900)] + [(None, 1, 1, 0), (1, 1, None, 0), (77777, 1, 1, 0), (2, 1, 7, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, score int")
    got = toxicity.judge(docs, labels).toPandas()
    assert len(got) == len(rows) + len(extra) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    ids = got.doc_id.dropna().astype(int)
    assert (got.held_out[ids.index] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]).all()
    mine = got[got.doc_id < 900]
    kept_back = mine[mine.held_out]
    assert (kept_back.predicted == (kept_back.doc_id % 4 == 0)).mean() > 0.9
    by_id = got.dropna().set_index("doc_id").predicted
    assert by_id[5000] == 1 and by_id[5001] == 0 and by_id[5002] == 1
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and 5001 in {r.doc_id for r in out.collect()}
    assert set(toxicity.judge(docs, labels.limit(0)).toPandas().predicted) == {0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = (toxicity.judge(docs, table).toPandas().sort_values("doc_id") for table in (labels, flipped))
    assert np.array_equal(one.score.values, two.score.values)


def test_pipeline(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    at = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, SMALL)
        if name != "mix_to_target_weights":
            assert at.dtypes == before.dtypes
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert kept["toxicity"] >= kept["simhash_near_dedup"] >= kept["benchmark_decontamination"] == kept["secret_scans"] == kept["mix_to_target_weights"]
    texts = Counter(d["text"] for d in docs if d["doc_id"] in kept["toxicity"])
    assert len(kept["simhash_near_dedup"]) <= len(texts)
    final = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in final.collect()} == kept["mix_to_target_weights"]


def test_trees_are_walked_as_written_and_do_not_swell_the_plan(spark):
    chance = random.Random(5)

    def grown(depth):
        if depth == 0 or chance.random() < 0.2:
            return chance.uniform(-1, 1)
        return chance.randrange(6), chance.uniform(0, 10), grown(depth - 1), grown(depth - 1)

    def walked(tree, features):
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree

    model = pii.Model([(chance.uniform(0.05, 1), grown(4)) for _ in range(20)] + [(0.5, 0.25)])
    rows = [([chance.uniform(0, 10) for _ in range(6)],) for _ in range(50)]
    for row in spark.createDataFrame(rows, "f array<double>").select("f", model.chance(F.col("f")).alias("chance")).collect():
        margin = 0.0
        for weight, tree in model.trees:
            margin += weight * walked(tree, row.f)
        assert row.chance == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-15)
    assert str(model.chance(F.col("f"))).count("when") < 10 and str(model.chance(F.col("f"))).count("CASE") < 10
    assert pii.Model([(1.0, 0.25)]).chance(F.col("f")) is not None and spark.range(1).select(pii.Model().chance(F.array(F.lit(0.0)))).first()[0] == 0.5
