import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import pii, warc
from trackspark.llm.common import new_folder

BIG = "<p>é</p>" * 400
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://b/ü x\r\ny", "<b>" + "z" * 3000), (5, "http://b/5", None), (6, "http://b/6", ""), (7, "http://c", "short"), (8, "http://c", "short"), (None, "http://d", BIG), (3, None, BIG), (9, "http://e", "end\r\n\r\n\r\n\r\n")]


def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    out = warc.archive_round_trip(pages(spark)).collect()
    assert len(out) == len(PAGES)
    for r in out:
        html = next(p[2] for p in PAGES if p[0] == r.page_id) or ""
        data = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = len(data) >= 1000 and html == BIG and r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))


def test_archives_are_gzip_and_filters_reach_the_reader(spark):
    folder = new_folder(spark, "warc-test")
    warc.write_archives(pages(spark), folder, max_file_bytes=600)
    everything = b""
    import glob

    for path in glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/*.warc.gz"):
        everything += gzip.open(path).read()
    assert everything.count(b"WARC-Type: response") == 9 and everything.count(b"WARC-Type: revisit") == 2
    assert b"x\r\ny" not in everything
    some = warc.read_archives(spark, folder, "full").where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b/") & (F.col("page_id") > 4))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "isnotnull" in plan
    assert sorted((r.page_id, bytes(r.payload)) for r in some.collect()) == [(5, b""), (6, b"")]
    skipped = warc.read_archives(spark, folder, "skip").where("page_id = 4").collect()
    assert skipped[0].payload is None and skipped[0].payload_bytes == 3003


def test_a_folder_without_scheme_is_on_the_default_file_system(spark, tmp_path):
    from trackspark.llm.common import qualified, shared_folder

    assert shared_folder(spark).startswith("file:")
    folder = qualified(spark, str(tmp_path / "plain"))
    assert folder == f"file:{tmp_path}/plain"
    warc.write_archives(pages(spark), folder)
    assert list((tmp_path / "plain").glob("*.warc.gz")) and warc.read_archives(spark, folder).where("record_type <> 'warcinfo'").count() == len(PAGES)


def test_scratch_is_removed(spark):
    import glob

    from trackspark.llm.common import cut_lineage, scratch, shared_folder

    found = lambda: set(glob.glob(shared_folder(spark).removeprefix("file://").removeprefix("file:") + "/trackspark-scratch/*"))
    before = found()
    with scratch():
        assert cut_lineage(spark.range(3)).count() == 3 and len(found()) == len(before) + 1
    assert found() == before


def test_one_page_that_very_many_repeat(spark):
    rows = [(k, f"http://x/{k}", BIG if k % 3 else f"{k}" * 1000) for k in range(600)]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id for r in out if r.record_type == "revisit"} == {k for k in range(600) if k % 3} - {599} and {r.refers_to for r in out} == {None, 599}


def foreign(kind, block, n, *more, eol="\r\n"):
    head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", f"WARC-Target-URI: http://x/{n}", *more, f"Content-Length: {len(block)}"]
    return (eol.join(head) + eol * 2).encode() + block + b"\r\n\r\n"


def test_archives_of_other_makers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"body \r\n\r\n end").digest()).decode()
    records = [
        foreign("warcinfo", b"software: z\r\n", 0, "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", 1, "Content-Type: application/http; msgtype=request"),
        foreign("response", http + b"body \r\n\r\n end", 2, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"),
        foreign("resource", b"plain", 3, "Content-Type: text/plain", "X-Folded: a\r\n b: c"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", 4, "Content-Type: application/http; msgtype=response"),
        foreign("response", http, 5, "WARC-Payload-Digest: md5:abc", "Content-Type: application/http", eol="\n"),
        foreign("response", http + b"z" * 3_000_000, 6, "Content-Type: application/http"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "three.warc").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    want = [("warcinfo", 0, None, None, None), ("request", 1, None, None, None), ("response", 2, 13, hashlib.sha1(b"body \r\n\r\n end").hexdigest(), b"body \r\n\r\n end"), ("resource", 3, 5, None, b"plain"), ("revisit", 4, 77, None, None), ("response", 5, 0, None, b""), ("response", 6, 3_000_000, None, b"z" * 3_000_000)]
    for mode in ("full", "verify", "skip"):
        out = warc.read_archives(spark, f"file://{tmp_path}", mode).collect()
        got = sorted(((r.record_type, int(r.record_id.rpartition(":")[2]), r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in out), key=lambda x: x[1])
        assert got == [(*w[:4], w[4] if mode == "full" else None) for w in want for _ in range(3)] and all(r.page_id is None for r in out)
    some = warc.read_archives(spark, f"file://{tmp_path}").where("record_type = 'response' and target_uri = 'http://x/2'").collect()
    assert [bytes(r.payload) for r in some] == [b"body \r\n\r\n end"] * 3
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(records[3][:-8])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, f"file://{tmp_path}/bad").collect()


def test_no_pages(spark):
    assert warc.archive_round_trip(pages(spark).where("false")).count() == 0


RULES = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_a_plain_search(spark):
    r = random.Random(7)
    bits = ["a@b.c", "@", ".", "_d@e.f", "1.2.3.4", "256.1.1.1", "00255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (988) 555-2485", "+", "é🎉", " ", "\n", "x", "12", "-", "4532015112830366", ".5.6.7.8", "+1+22 3333 4444", "a@b@c.d."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1" * 50_000, "a." * 20_000 + "@x", "a@" + "b." * 20_000, "+" + "(" * 50_000, "1.2.3.4 " * 3000, "4111 1111 1111 1111 7 " * 50]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "a@b.c", 1), (0, texts[0], 0)], "doc_id long, text string, spans int")
    out = pii.find_personal_data(docs).collect()
    assert len(out) == len(texts) + 2
    for row in out:
        text = "a@b.c" if row.doc_id is None else texts[row.doc_id] or ""
        assert row.base_spans == brute(text), text[:200]
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == (row.base_spans.count(",") + 1 if row.base_spans else 0)


def test_contexts_find_what_no_pattern_matches(spark):
    rows = [(k, f"Well then call me at +1 (988) 555-{1000 + k} today") for k in range(12)]
    rows += [(100, "Well then call me at 0049-30-1234{x} today".replace("{x}", "567")), (101, "it was in 19870 or so"), (102, "chapter 12345 follows")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "phone:21:36" and out[100].base_spans == "" and out[100].n_found == 1
    assert out[101].spans == out[102].spans == "" and all(out[k].spans == out[k].base_spans != "" for k in range(12))
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_of_very_long_words(spark):
    a, b = "w" * 300, "\u00e9v" * 200
    rows = [(k, f"{a} {b} +1 (988) 555-{1000 + k} {b} {a}") for k in range(12)]
    rows += [(100, f"{a} {b} 0049-30-1234567 {b} {a}"), (101, f"x{a[1:]} {b[:-1]}y 0049-30-7654321 z{b[1:]} {a}"), (102, f"{'q ' * 100}{a[:-1]}x {b} 0049-30-1111111\t{b}  {a}")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].n_found for k in (100, 101, 102)] == [1, 0, 1]


def test_lists_with_one_word_labels_have_contexts(spark):
    rows = [(k, f"Tel: +1 (988) 555-{1000 + k} Fax: +1 (988) 555-{3000 + k}") for k in range(12)]
    rows += [(100 + k, f"+1 (988) 555-{5000 + k}\n+1 (988) 555-{7000 + k}") for k in range(12)]
    rows += [(200, "Tel: 0049-30-1234567 Fax: 0049-30-7654321"), (201, "0049-30-2345678\n+1 (988) 555-9999")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[200].spans == "phone:5:20,phone:26:41" and out[200].base_spans == ""
    assert out[201].spans == "phone:0:15,phone:16:33" and out[201].n_found == 1


def test_chains_of_patterns_are_followed_to_their_end(spark):
    # pattern k holds 12 seeds, 4 instances that pattern k - 1 makes known, and 4 new ones
    rows = []
    for k in range(5):
        held = [f"+1 (988) 555-{1000 + j}" for j in range(12 if k else 16)]
        held += [f"0049-30-77{j}{i}" for j in ([k - 1, k] if k else [k]) for i in range(4)]
        w = "abcdefgh"[k]
        rows += [f"So {w}one {w}two {x} {w}three {w}four" for x in held]
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r.n_found + r.n_phone == 1 for r in out) and sum(r.n_found for r in out) == 4 + 8 * 4


def test_words_in_the_place_of_strong_patterns_are_found(spark):
    rows = [(k, f"If in doubt write to user{k}@example.com for help") for k in range(40)]
    rows += [(100, "If in doubt write to john(at)example(dot)com for help"), (101, "é  If in doubt write to\n(john [at] example.com) for help"), (102, "not for help")]
    rows += [(200 + k, f"now call at +1 (988) 555-{1000 + k} again") for k in range(10)] + [(300 + k, f"now call at {w} again") for k, w in enumerate("home work noon dusk".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    text = dict(rows)
    assert [out[k].n_found for k in (100, 101, 102)] == [1, 1, 0]
    for k, want in ((100, "john(at)example(dot)com"), (101, "john [at] example.com")):
        kind, a, b = out[k].spans.split(":")
        assert kind == "email" and text[k][int(a) : int(b)] == want
    assert not any(out[k].n_found for k in range(300, 304))


def bootstrap(texts, least_known=4, least_share=0.8, least_score=0.9):
    """Instances that contexts find, by kind: the whole graph in memory, words of all texts from the start."""
    places = []
    for t in texts:
        units = re.findall(pii.UNIT, t)
        run = [bool(re.match(f"^{pii._TOKEN}", u)) for u in units]
        last = [pii.EDGE, *[pii.NEXT_RUN if r else u.split(" ")[-1].lower() for u, r in zip(units, run, strict=True)]]
        first = [*[pii.NEXT_RUN if r else u.split(" ")[0].lower() for u, r in zip(units, run, strict=True)], pii.EDGE]
        for k, u in enumerate(units):
            core = re.match(r"""^[("'\[{<]*+(.*?)[)"'\]}>.,;:!?]*$""", u).group(1)
            pats = [f"0 {last[k]}", f"1 {last[k]} _ {first[k + 1]}"]
            if last[k] not in (pii.EDGE, pii.NEXT_RUN):
                pats.append(f"2 {last[k - 1]} {last[k]}")
            places += [(p, core, run[k]) for p in pats if core]
    kind_of = lambda x: next((k for k in pii.KINDS if re.search(k, ",".join(s.split(":")[0] for s in brute(x).split(",")))), None)
    known = {i: kind_of(i) for _, i, r in places if r and kind_of(i)}
    seeds, runs, words, sought = set(known), {}, {}, set()
    for p, i, r in places:
        (runs if r else words).setdefault(p, set()).add(i)
    while True:
        strong = {}
        for p, held in runs.items():
            held = held | (words.get(p, set()) if p in sought else set())
            count = [sum(known.get(i) == k for i in held) for k in pii.KINDS]
            if max(count) >= least_known and max(count) >= least_share * len(held):
                strong[p] = (pii.KINDS[count.index(max(count))], max(count) / (len(held) + 1))
        if set(strong) - sought:
            sought |= set(strong)
            continue
        scores = {}
        for p, (kind, share) in strong.items():
            for i in runs[p] | words.get(p, set()):
                if i not in known:
                    scores.setdefault((i, kind), []).append(share)
        new = {}
        for (i, kind), shares in scores.items():
            score = 1 - np.prod([1 - s for s in shares]) if re.search("[0-9@]", i) else max(shares)
            if score >= least_score and (i not in new or (score, -pii.KINDS.index(kind)) > new[i]):
                new[i] = (score, -pii.KINDS.index(kind), kind)
        if not new:
            return {(i, k) for i, k in known.items() if i not in seeds}
        known |= {i: v[2] for i, v in new.items()}


def test_discovery_equals_a_bootstrap_in_memory(spark):
    r = random.Random(11)
    vocabulary = ["call", "me", "at", "mail", "to", "card", "no", "the", "of", "and", "in", "host", "is", "see"]
    leads = {"phone": ["call me at", "phone no"], "email": ["mail me at", "write to"], "ip": ["host is"], "card": ["card no"]}
    make = {"phone": lambda: f"+1 (988) 555-{r.randint(1000, 9999)}", "email": lambda: f"u{r.randint(0, 999)}@ex.com", "ip": lambda: f"10.0.{r.randint(0, 255)}.{r.randint(0, 255)}", "card": lambda: "4111111111111111"}
    odd = {"phone": lambda: f"0049-30-{r.randint(1000, 1099)}", "email": lambda: r.choice(["ann [at] ex [dot] com", "bob(at)ex.com", "nobody"]), "ip": lambda: f"fe80::{r.randint(1, 40)}", "card": lambda: f"4111-{r.randint(0, 9)}"}
    texts = []
    for _ in range(500):
        words = [r.choice(vocabulary) for _ in range(r.randint(2, 9))]
        for _ in range(r.randint(0, 2)):
            kind = r.choice(list(leads))
            words.insert(r.randint(0, len(words)), f"{r.choice(leads[kind])} {(make if r.random() < 0.85 else odd)[kind]()} {r.choice(['now', 'or', 'please'])}")
        texts.append(" ".join(words))
    want = bootstrap(texts)
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = set()
    for row in out:
        for span in set(row.spans.split(",")) - set(row.base_spans.split(",")):
            kind, a, b = span.split(":")
            got.add((texts[row.doc_id][int(a) : int(b)], kind))
    assert len(want) > 20 and got == want


def test_common_words_are_given_up_before_their_places_are_written(spark):
    # "the" stands before many numbers, and before far more words
    rows = [f"so the +1 (988) 555-{1000 + k} and the {'abcdefghij'[j]}{'klmnopqrst'[k]} end {k}{j}" for k in range(10) for j in range(10)]
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sum(r.n_found for r in out) == 0 and sum(r.n_phone for r in out) == 100


def test_common_words_count_once_other_patterns_know_them(spark):
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    odd = (f"u{letters(k)}" for k in range(99999))
    words = [f"w{letters(k)}" for k in range(60)]
    texts = [f"dial{'abcd'[x]} +1 (988) 555-{1000 + k + 200 * x}" for x in range(4) for k in range(200)]
    texts += [f"dial{'abcd'[k % 4]} {w}" for k, w in enumerate(words)]
    # "the" stands before few numbers and many words, which the other patterns make known
    texts += [f"the +1 (988) 555-{1000 + k}" for k in range(4)] + [f"the {w}" for w in words for _ in range(16)] + ["the wzzz"]
    texts = [f"{next(odd)} {t} {next(odd)} {next(odd)}" for t in texts]
    out = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = bootstrap(texts)
    assert ("wzzz", "phone") in want and len(want) == 61
    assert sum(r.n_found for r in out) == 60 * 17 + 1
