from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import char_tagger as ct
from kinmatch.llm import forest, pii, secret_scan, warc
from kinmatch.llm import license_scan as ls
from kinmatch.llm.shared import new_folder
from tests.llm.helpers import empty_documents, odd_documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive(t: str) -> list[tuple[int, int, str]]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns():
    r = random.Random(1)
    bits = [*"aB@.-+_%()  0123456789", "1.2.3.4", "a@b.c", "@", "..", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "１", "0" * 9]
    for _ in range(8000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        assert pii.base_spans(t) == naive(t), t


@pytest.mark.parametrize("t", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000, "a@" * 100_000, "1 " * 100_000])
def test_patterns_take_linear_time(t):
    assert pii.base_spans(t) is not None


def test_gradients():
    t = ct.Tagger(3, 1)
    g = np.random.default_rng(0)
    x, y = g.integers(0, ct.N_CLASSES, (4, 7)), g.integers(0, ct.N_LABELS, (4, 7))
    _, grads = t.loss(x, y)
    for name, w in t.w.items():
        for _ in range(4):
            at = tuple(g.integers(s) for s in w.shape)
            before = w[at]
            w[at] = before + 1e-5
            up = t.loss(x, y)[0]
            w[at] = before - 1e-5
            down = t.loss(x, y)[0]
            w[at] = before
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


@pytest.fixture(scope="module")
def tagger() -> ct.Tagger:
    return pii.trained()


def test_held_out_accuracy(tagger):
    x, y = pii.labelled_windows(pii.Recipe(windows=400, seed=99))
    w = tagger.packed()
    got = ct.viterbi(w, ct.emissions(w, np.ascontiguousarray(x.T))).T
    hit = (got == y) & (y > 0)
    assert hit.sum() / (y > 0).sum() > 0.9 and hit.sum() / (got > 0).sum() > 0.9


def test_windows_left_out_are_empty(tagger):
    w = tagger.packed()
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghij .,1@") for _ in range(200)) for _ in range(200)]
    x = np.stack([ct.classes_of(np.frombuffer(t.encode(), np.uint8)) for t in texts], axis=1).astype(np.int64)
    e = ct.emissions(w, x)
    some = set(ct.undecided(w, e).tolist())
    labels = ct.viterbi(w, e)
    assert all(not labels[:, k].any() for k in range(200) if k not in some)


def test_spans_across_windows(spark, tagger):
    pads = ["word " * n for n in range(30, 90, 3)]
    texts = [p + "write to ana.lopez at example dot com today, or to x@y.org" for p in pads]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tagger).collect()
    added = 0
    for row in got:
        t = texts[row["doc_id"]]
        base = naive(t)
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest() and row["n_email"] == 1
        spans = row["spans"].split(",")
        assert f"email:{base[0][0]}:{base[0][1]}" in spans
        at = t.index("ana.lopez")
        added += any(s.startswith("email:") and int(s.split(":")[1]) < at + 22 and int(s.split(":")[2]) > at for s in spans)
    assert added >= 0.8 * len(texts)


def test_reconciling():
    w = pii.Windows(least_odds=0, least_length=1)
    assert pii.reconciled([(0, 10, 1, 5.0), (8, 14, 1, 3.0), (12, 20, 2, 4.0), (30, 34, 3, 1.0)], w) == [(0, 14, 1, 5.0), (30, 34, 3, 1.0)]
    assert pii.reconciled([], w) == []


def test_pii_of_odd_and_no_rows(spark, tagger):
    got = pii.personal_data(odd_documents(spark), tagger).collect()
    assert len(got) == 9 and all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in got)
    assert pii.personal_data(empty_documents(spark), tagger).count() == 0


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2001 Somebody\n\n" + ls.TEXTS["MIT"]
    changed = mit.upper().replace(",", " ,").replace("SUBLICENSE", "sub-licence")
    docs = [
        (1, mit), (2, changed), (3, "intro\n\n" + ls.TEXTS["ISC"].replace("\n\n", "\n") + "\n\nend"), (4, "This work is licenced under the GNU General Public Licence, Version 3"),
        (5, mit + " and more"), (6, "x\nLICENSED UNDER CC BY-NC 4.0!\ny\nLicensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License, v2.0"), (8, "Some licensed under the apache license, version 2.0 words"),
    ]
    got = {(x["doc_id"], x["kind"], x["license"]): x["n"] for x in ls.license_scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1, "document", "MIT"] == got[2, "document", "MIT"] == 1 and (5, "document", "MIT") not in got
    assert got[3, "paragraph", "ISC"] == 1 and got[4, "line", "GPL-3.0"] == 1 and got[6, "line", "CC-BY-NC-4.0"] == 2 and got[7, "document", "Apache-2.0"] == 1
    assert not any(d == 8 for d, _, _ in got)
    own = ls.known_digests(spark, spark.createDataFrame([("House", "Ask the house before copying")], "license string, text string"))
    assert ls.license_scan(spark.createDataFrame([(1, "ask the HOUSE, before copying!")], "doc_id bigint, text string"), own).count() == 2
    assert ls.license_scan(odd_documents(spark)).count() == 0 == ls.license_scan(empty_documents(spark)).count()


def test_forest_separates_held_out_findings(spark):
    rows = secret_scan.described(secret_scan.candidates(secret_scan.labelled_findings(spark, 3000))).where("start = at").select(*secret_scan.FEATURES, "label", "doc_id").collect()
    t = np.array([[float(v) for v in r] for r in rows])
    train = t[:, -1] < 2400
    trees = forest.fit(t[train, :-2], t[train, -2])
    got, truth = forest.predict(trees, t[~train, :-2]) >= 0.5, t[~train, -2] > 0.5
    assert (got == truth).mean() > 0.95
    sql = spark.createDataFrame([tuple(map(float, r[:-2])) for r in t[:50]], secret_scan.FEATURES).select(F.expr(forest.to_sql(trees, secret_scan.FEATURES)).alias("s"))
    assert [x["s"] for x in sql.collect()] == pytest.approx(forest.predict(trees, t[:50, :-2]).tolist(), abs=1e-5)


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    docs = [(1, f'é x token = "{key}" y', "src1"), (2, f"commit {key} of the build", "CHANGELOG"), (3, "password = your_password_here_please", "docs/x.md"), (4, "internationalizationofeverything", None), (5, "x" * 50_000, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = secret_scan.secret_scan(df).collect()
    assert [(x["doc_id"], x["start"], x["length"], x["secret"]) for x in got] == [(1, 13, 40, key)]
    odd = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    assert secret_scan.secret_scan(odd).count() == 0 == secret_scan.secret_scan(odd.limit(0)).count()
    plan = secret_scan.secret_scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [(1, "http://a/ä b", "x" * 2000), (2, None, "x" * 2000), (3, "http://c", None), (4, "http://d", "small"), (5, "http://e", "small"), (None, "http://f", "x" * 2000), (7, "http://g\n1", "é" * 600), (9, "u", "x" * 2000), (9, "u", "x" * 2000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id bigint, url string, html string, digest string")
    folder = new_folder(spark, "warc")
    index = warc.write_archives(pages, folder, archive_bytes=700)
    got = sorted((tuple(x) for x in warc.read_records(index, folder).collect()), key=str)
    want = []
    for page, url, html in PAGES:
        payload = (html or "").encode()
        copies = [p for p, _, h in PAGES if h == html and p is not None]
        refers = max(copies) if page is not None and len(payload) >= 1000 and page < max(copies) else None
        want.append((page, url, "response" if refers is None else "revisit", refers, len(payload), hashlib.sha1(payload).hexdigest(), payload if refers is None else None))
    assert got == sorted(want, key=str)
    one = warc.read_records(index.where("page_id = 7"), folder).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == ("é" * 600).encode()
    assert warc.read_records(warc.write_archives(pages.limit(0), new_folder(spark, "warc")), folder).count() == 0


def test_ranges_are_coalesced():
    assert list(warc.coalesced([(0, 10), (10, 5), (100, 5)], gap=20, most=1000)) == [(0, 15, [0, 1]), (100, 105, [2])]
    assert list(warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=5, most=20)) == [(0, 20, [0, 1]), (20, 30, [2])]
    assert list(warc.coalesced([])) == []


def test_damaged_records_are_refused():
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2026-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloax"))


def test_secrets_in_env_form(spark):
    key = hashlib.sha1(b"k").hexdigest()
    docs = [(1, f"API_KEY={key}", ".env"), (2, f"x PRODUCTION_CLIENT_SECRET={key}\ny", ".env"), (3, f"see http://h/p?token={key} z", "src1"), (4, "QUJDREVGR0hJSktMTU5PUA== z", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, path string")
    found = {(x["doc_id"], x["start"], x["secret"]) for x in secret_scan.candidates(df).collect()}
    assert {(1, 8, key), (2, 2, "PRODUCTION_CLIENT_SECRET"), (2, 27, key), (3, 21, key), (4, 0, "QUJDREVGR0hJSktMTU5PUA==")} <= found
    got = secret_scan.secret_scan(df.where("doc_id < 4"), path_col="path").collect()
    assert sorted((x["doc_id"], x["start"], x["length"], x["secret"]) for x in got) == [(1, 8, 40, key), (2, 27, 40, key), (3, 21, 40, key)]


def test_unquoted_assignments_are_trained_on(spark):
    labelled = secret_scan.labelled_findings(spark, 1000)
    kept = secret_scan.candidates(labelled).where("start = at").select("doc_id")
    lost = labelled.join(kept, "doc_id", "left_anti").where(F.col("label") == 1)
    assert lost.count() == 0


def test_sql_of_the_license_scan_agrees(spark):
    import duckdb

    r = random.Random(6)
    known = [x for all_ in ls.NOTICES.values() for x in all_] + [f"{title}\n\n{text}" for name, text in ls.TEXTS.items() for title in ls.TITLES[name]]
    other = ["Copyright (c) 2020 Someone", "copyright holder notices stay", "All rights reserved.", "plain words", "", " ", "v2.0 and ver 3", "x.5 ..7 \x01 y", "## MIT licence", "© 1999"]
    texts = []
    for _ in range(300):
        t = r.choice(["\n", "\n\n", " "]).join(r.choice(known if r.random() < 0.5 else other) for _ in range(r.randrange(1, 5)))
        texts.append(r.choice([str.upper, str.lower, lambda x: x, lambda x: x.replace("license", "licence"), lambda x: x.replace(" ", "  ")])(t))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), (-1, None)])
    found = con.execute(ls.OP8_SQL)
    names = [d[0] for d in found.description]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id bigint, text string")
    got = sorted(tuple(row) for row in ls.license_scan(docs).select(*names).collect())
    assert got == sorted(found.fetchall()) and len({row[names.index("license")] for row in got}) > 10
