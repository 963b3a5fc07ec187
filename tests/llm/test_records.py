"""PII, packing, WARC, HTML and the pipeline, against brute force and round trips."""

import gzip
import hashlib
import html as html_lib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from conftest import SMALL
from paysift.llm import html_extraction, packing, pii, warc

DOCS = "doc_id long, text string"


# --- PII ---

def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


PII_ROWS = [
    (1, "a 4242 4242 4242 4242 b 4242-4242-4242-4242, 4242424242424242; +1 (017) 555-7713"),
    (2, "again 4242424242424242 and DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432."),
    (3, "born 1990-02-28, 02/28/1990, 28.02.1990 and 2/3/1990, 29/12/2001"),
    (4, "und.34@mail7.example.com, UND.34@mail7.example.com x_y@b.org 123-45-6789 10.0.0.255"),
    (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: Abc123def456ghi789 token: onlylettersandnodigits'),
    (6, "kept: 4242424242424241 1990-02-30 13/13/1990 666-45-6789 000-11-2222 256.1.1.1 1.2.3 DE00370400440532013000 1234567 a@b"),
    (7, None), (8, ""), (2, "again 4242424242424242 and DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432."), (None, "10.0.0.255"),
]


def test_pseudonyms_keep_format_and_links(spark):
    rows = pii.pseudonymized(spark.createDataFrame(PII_ROWS, DOCS)).collect()
    assert len(rows) == len(PII_ROWS)
    new = {x.doc_id: x.text for x in rows}
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for i, old in PII_ROWS:
        if old and i not in (3, 4, None):
            assert len(new[i]) == len(old)
    cards = re.findall(r"\d(?:[ -]?\d){15}", new[1])
    assert len(cards) == 3 and all(luhn(re.sub(r"\D", "", c)) for c in cards)
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and re.sub(r"\D", "", cards[0]) in new[2]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", new[1]) and "555-7713" not in new[1]
    ibans = re.findall(r"DE[\d ]+\d|GB\w+", new[2])
    assert [mod97(x.replace(" ", "")[4:] + x.replace(" ", "")[:4]) for x in ibans] == [1, 1]
    iso, us, dots, short, european = re.match(r"born (\S+), (\S+), (\S+) and (\S+), (\S+)$", new[3]).groups()
    y, m, d = iso.split("-")
    assert re.match(r"29/12/\d{4}$", european) and re.match(r"\d\d?/\d\d?/\d{4}$", short)
    assert us == f"{m}/{d}/{y}" and dots == f"{d}.{m}.{y}" and iso != "1990-02-28"
    assert shape(new[5]) == shape(PII_ROWS[4][1]) and re.search(r'"[0-9a-f]{40}"', new[5])
    assert "UND" not in new[4] and new[4].lower().count(new[4].split("@")[0].lower()) == 2 and "123-45-6789" not in new[4]
    assert new[6] == PII_ROWS[5][1]
    assert new[7] is None and new[8] == "" and new[4].endswith(new[None])
    assert [len(x.kinds) for x in rows] == [x.n_values for x in rows]
    assert Counter(k for x in rows if x.doc_id == 5 for k in x.kinds) == {"secret": 2}


def test_pseudonyms_can_be_undone_and_depend_on_the_key(spark):
    d = spark.createDataFrame(PII_ROWS, DOCS).withColumn("r", F.lit(1)).withColumn("kinds", F.lit("x"))
    coded = pii.replace(d, key="k1")
    assert coded.columns == d.columns
    back = coded.withColumn("text", pii.replaced(F.col("text"), "k1", undo=True)["text"])
    assert back.collect() == d.collect()
    assert coded.collect() != pii.replace(d, key="k2").collect()
    assert pii.replace(d.limit(0)).collect() == []


def test_feistel_is_a_permutation(spark):
    x = F.array((F.col("id") % 7), F.floor(F.col("id") / 7) % 5, F.floor(F.col("id") / 35))
    r = F.array(*[F.lit(n).cast("long") for n in (7, 5, 3)])
    rows = spark.range(105).select(pii.feistel(x.cast("array<long>"), r, F.lit("t"), "k").alias("y")).collect()
    got = {tuple(q.y) for q in rows}
    assert len(got) == 105 and all(0 <= a < 7 and 0 <= b < 5 and 0 <= c < 3 for a, b, c in got)


# --- packing ---

def tokens(t):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t or "", add_special_tokens=False).ids + [2]


def test_packing_is_whole_and_tight(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["naïve", "the", "12", "(x)", "日本", "don't", "\n\n", "<|endoftext|>", "🙂"]) for _ in range(r.choice([0, 1, 30, 200, 600, 1500])))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, "a" * 5000), (203, " " * 3000 + "x"), (204, "é" * 2500), (5, docs[5][1]), (None, "null id")]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).repartition(5), with_ids=True).collect()
    by_doc = defaultdict(list)
    for x in rows:
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
        by_doc[x.doc_id].append(x)
    for i, t in docs:
        want = tokens(t)
        parts = sorted(by_doc[i], key=lambda x: x.piece)[:: 2 if i == 5 else 1]
        assert sum((list(x.ids) for x in parts), []) == want
        assert [x.start for x in parts] == [0, *np.cumsum([x.length for x in parts])[:-1]]
        assert all(x.length == 1024 for x in parts[1:]) and len(parts) == -(-len(want) // 1024)
    places = defaultdict(list)
    for x in rows:
        places[x.sequence_id].append((x.offset, x.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 1024
    assert len(places) <= 1.06 * sum(x.length for x in rows) / 1024 + 1
    assert packing.pack(spark.createDataFrame(docs, DOCS).limit(0)).collect() == []


def test_best_fit_against_a_plain_search():
    r = random.Random(2)
    for n_open in (1, 4, 50):
        fast, bins, closed = packing.BestFit(100, n_open), [], set()
        for _ in range(2000):
            size = r.randrange(1, 101)
            at, offset = fast.place(size)
            fits = [b for b in range(len(bins)) if b not in closed and bins[b] >= size]
            if fits:
                assert bins[at] == min(bins[b] for b in fits) and at not in closed
            else:
                open_bins = [b for b in range(len(bins)) if b not in closed]
                if len(open_bins) >= n_open:
                    (gone,) = [b for b in fast.closed if b != at]
                    assert bins[gone] == min(bins[b] for b in open_bins)
                    closed.add(gone)
                assert at == len(bins)
                bins.append(100)
            assert offset == 100 - bins[at]
            bins[at] -= size
            if not bins[at]:
                closed.add(at)


# --- WARC ---

def test_warc_round_trip(spark, tmp_path):
    long = "x" * 300_000 + "ü"
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "é" * 499), (6, "u", "é" * 499),
            (7, "u", "é" * 500), (9, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", "é" * 500), (10, "WARC/1.1", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    chunks = warc.read_archives(archives, f"file://{tmp_path}/w").collect()
    payloads = defaultdict(list)
    for x in sorted(chunks, key=lambda x: (x.path, x.record_id, x.chunk_no)):
        assert len(x.chunk) <= warc.CHUNK
        payloads[x.path, x.record_id, x.page_id, x.record_type, x.refers_to].append(x)
    assert len(chunks) > len(rows)
    big = [v for v in payloads.values() if v[0].page_id == 2][0]
    assert b"".join(x.chunk for x in big) == long.encode() and [x.last for x in big] == [False] * (len(big) - 1) + [True]
    sha, so_far = hashlib.sha1(), 0
    for x in big:
        sha.update(x.chunk)
        so_far += len(x.chunk)
        assert (x.digest_so_far, x.bytes_so_far) == (sha.hexdigest(), so_far)
    got = Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.round_trip(pages).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        first = max((j for j, _, u in rows if u == t and j is not None), default=None) if len(b) >= 1000 else i
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_reader_refuses_damage():
    whole = b"".join(warc.record_parts(1, "u", "hello world", 11, hashlib.sha1(b"hello world").hexdigest(), None, False))
    import io
    assert [x[8] for x in warc.read_records(io.BytesIO(whole + whole))] == [b"hello world"] * 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole.replace(b"hello", b"hallo"))))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(whole[:-10])))
    with pytest.raises(EOFError):
        list(warc.read_records(gzip.open(io.BytesIO(gzip.compress(whole)[:-30]))))


# --- HTML ---

def test_common_lines_are_a_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(1500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(10))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_extraction.common_lines(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<br>c&nbsp;d <b>e</b>f", "a b c d ef"),
    ("<nav>menu</nav><article><header><h1>T</h1></header><p>x &lt;y&gt;</p><aside>no</aside></article><footer>f</footer>", "T x <y>"),
    ("<body><div class='cookie-notice'>ok?</div><div id=content><p>main</p><section class=\"comments\"><p>reader</p></section></div>", "main"),
    ("<main><p>in main</p><article class=comment>reply</article></main><div>beside</div>", "in main"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>c</p> --><p title='a>b'>t</p>", "t"),
    ("<article><p>one<form><input>q</form><p style='display: none'>h</p><p>two</article></div></b>tail", "one two"),
    ("<p>1 < 2 & 3 > 2</p><unclosed", "1 < 2 & 3 > 2 <unclosed"),
])
def test_blocks(page, text):
    assert html_extraction.main_text(html_extraction.blocks(page), None)[0] == text


def slow_extract(rows):
    """Every page by a plain search through the pages in order, both ways, for the first with other lines."""
    found = [html_extraction.blocks(x[2]) for x in rows]
    same = lambda k: (html_extraction.address(rows[k][1])[0], html_extraction.open_lines(found[k]))
    path = lambda k: html_extraction.address(rows[k][1])[1]
    order = sorted(range(len(rows)), key=lambda k: (same(k)[0], path(k), -(1 << 63) if rows[k][0] is None else rows[k][0]))
    out = Counter()
    for at, k in enumerate(order):
        near = []
        for step in (-1, 1):
            j = at
            while 0 <= j + step < len(order) and same(order[j + step]) == same(k):
                j += step
            end, j = order[j], j + step
            if 0 <= j < len(order) and same(order[j])[0] == same(k)[0]:
                near.append((html_extraction.nearness(path(end), path(order[j])), found[order[j]], rows[order[j]][0]))
        _, partner, partner_id = max(near, key=lambda x: x[0], default=(0, None, None))
        text, shared = html_extraction.main_text(found[k], partner)
        out[rows[k][0], rows[k][1], text, len(text), partner_id, shared] += 1
    return out


def test_extraction_deletes_lines_shared_with_the_nearest_page(spark):
    r = random.Random(4)
    rows = []
    for k in range(150):
        host = r.choice(["a.org", "a.org", "a.org", "b.org", "www.c.org"])
        body = "".join(f"<p>{r.choice('abcdefgh') * 5} {r.randrange(40)}</p>" for _ in range(r.randrange(6)))
        article = f"<article>{body}</article>" if r.random() < 0.3 else body
        rows.append((k, f"http://{host}/{r.choice('xyz')}/{r.choice('pq')}/{k}", f"<p>Site of {host}</p>{article}<div><p>Contact us</p></div>"))
    rows += [(900, None, "<p>no url</p>"), (None, "http://a.org/x/p/3", "<p>Site of a.org</p>null id"), (901, "http://a.org/x/p/4", None), (902, "::bad", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n_runs in (1, 7, 40):
        got = html_extraction.extract(pages.repartition(3), n_runs=n_runs)
        assert Counter(map(tuple, got.collect())) == slow_extract(rows)
    assert "Contact us" not in {x.text for x in got.collect() if x.text.startswith("aaaaa")}
    assert html_extraction.extract(pages.limit(0)).collect() == []


def test_equal_pages_in_a_row_get_equal_texts(spark):
    """Rows of equal pages of one to 90, so that some begin and end in other runs, or fill several."""
    r = random.Random(6)
    rows = []
    while len(rows) < 400:
        body, article = r.choice("abcdef"), r.random() < 0.2
        for _ in range(r.choice([1, 1, 2, 5, 30, 90])):
            host = "a.org" if len(rows) < 330 else "b.org"
            k = len(rows)
            url = f"http://{host}/{'wxyz'[k // 140]}/{k // 40:03}/{k // 7:03}/{k:04}"
            text = f"<p>Body {body} of the page</p>" + "".join(f"<p>{x}</p>" for x in ("one", "two"))
            rows.append((k, url, f"<p>Site menu</p>{'<article>' + text + '</article>' if article else text}<p>Contact us</p>"))
    rows += [(k, u, h) for k, u, h in rows[100:104] for _ in range(3)]  # repeated rows
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = slow_extract(rows)
    for n_runs in (1, 6, 50):
        got = html_extraction.extract(pages.repartition(4), n_runs=n_runs).collect()
        assert Counter(map(tuple, got)) == want
    assert not any("Site menu" in x.text for x in got)  # every page has a partner


@pytest.mark.parametrize("n_runs", [1, 3])
def test_five_equal_pages_and_another(spark, n_runs):
    rows = [(k, f"http://a.org/{k}", "<p>Site menu</p><p>same body</p>") for k in range(5)] + [(9, "http://a.org/9", "<p>Site menu</p><p>other body</p>")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), n_runs=n_runs).collect()
    assert {(x.page_id, x.text) for x in got} == {*((k, "same body") for k in range(5)), (9, "other body")}


def test_class_names_are_evidence_only(spark):
    rows = [(0, "http://a.org/0", "<p>Site menu</p><p class='lead-in side'>The lead.</p><div class=ads>Buy now</div>"),
            (1, "http://a.org/1", "<p>Site menu</p><p>The other page.</p><div class=ads>Buy now</div>"),
            (2, "http://b.org/2", "<p class='lead-in side'>The lead.</p>"),
            (3, "http://c.org/3", "<div class=menu>m</div><p>Plain.</p>")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == {0: "The lead.", 1: "The other page.", 2: "The lead.", 3: "Plain."}


def test_partners_over_the_borders_of_runs():
    """Against the pages in order: any cut of a sequence in runs gives each run the same outer partners."""
    r = random.Random(7)
    for _ in range(2000):
        pages = [("h", f"/{k:02}", k, r.choice("ab")) for k in range(r.randrange(1, 14))]
        cuts = sorted(r.sample(range(1, len(pages)), min(r.randrange(6), len(pages) - 1)))
        runs = [pages[a:b] for a, b in zip([0, *cuts], [*cuts, len(pages)])]
        edges = []
        for run in runs:
            rows = []
            for p in run:
                if rows and rows[-1]["same"] == (p[0], p[3]):
                    rows[-1]["last"] = p
                else:
                    rows.append({"same": (p[0], p[3]), "first": p, "last": p})
            edges.append(rows if len(rows) <= 4 else rows[:2] + rows[-2:])
        for run, (before, begin, end, after) in zip(runs, html_extraction.beside(edges)):
            i = j = pages.index(run[0])
            while i and pages[i - 1][3] == run[0][3]:
                i -= 1
            j = pages.index(run[-1])
            while j + 1 < len(pages) and pages[j + 1][3] == run[-1][3]:
                j += 1
            assert (before, begin) == (pages[i - 1] if i else None, pages[i][1])
            assert (after, end) == (pages[j + 1] if j + 1 < len(pages) else None, pages[j][1])


# --- pipeline ---

def test_pipeline_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", "s", 0), (90002, "w " * 3000, "en", "s", 6000)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(5)).withColumn("_key", F.lit("clash")).withColumn("fp", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, SMALL)
        assert after.columns == rows.columns, name
        n = after.count()
        assert 0 < n <= rows.count()
        assert stage(spark, rows.limit(0), SMALL).collect() == []
        rows = spark.createDataFrame(after.collect(), after.schema)
    ids = [x.doc_id for x in rows.collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
    assert {x.doc_id for x in packed.collect()} == set(ids)


def test_pipeline_equals_its_stages_by_hand(spark):
    rows = E.queries()["pipeline"](spark, SMALL).collect()
    docs = {x.doc_id: x for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {x.doc_id for x in E.queries()["op3_quality_rules"](spark, SMALL).where("kept").collect()}
    components = {x.doc_id: x.component_id for x in E.queries()["op8_simhash_dedup"](spark, SMALL).collect()}
    bad = {x.doc_id for x in E.queries()["op2_decontamination"](spark, SMALL).where("contaminated").collect()}
    texts = {x.doc_id: x.text for x in E.queries()["op9_pii"](spark, SMALL).collect()}
    first = {}
    for i in sorted(kept):  # links lead over documents that are gone, so groups are made again of what is kept
        first.setdefault(components[i], i)
    from test_text_operators import slow_components, slow_fingerprint
    order = sorted(kept)
    least = {}
    for i, k in zip(order, slow_components([slow_fingerprint(docs[i].text) for i in order])):
        least.setdefault(k, i)
    want = {i: tokens(texts[i]) for i in least.values() if i not in bad}
    got = defaultdict(list)
    for x in sorted(rows, key=lambda x: (x.doc_id, x.piece)):
        got[x.doc_id].append(x.ids_crc32)
    crc = lambda ids: [zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) for s, n in packing.cut(len(ids))]
    assert got == {i: crc(ids) for i, ids in want.items()}


QUERIES = sorted(k for k in E.queries() if re.match(r"op\d+_", k))


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in sorted(QUERIES, key=lambda k: int(re.match(r"op(\d+)", k)[1]))] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "pii", "packing"]


@pytest.mark.parametrize("name", ["op2_decontamination", "op9_pii"])
def test_native_plans_run_no_python(spark, name):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_html_of_the_tables(spark):
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for x in E.queries()["op5_html_extraction"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[x.page_id], re.S)[1]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", article))
        assert x.text == " ".join(html_lib.unescape(text).split())


def test_pii_beside_other_numbers_and_words(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    rows = [(f"card {card} 12/26", ["card"]), (f"{card} 123", ["card"]), (f"no 12 {card}", ["card"]), (f"12345 {card}.", ["card"]),
            (f"{card} 1234", ["card"]), (f"{card} 5500 0000 0000 0004", ["card", "card"]), ("4111-1111-1111-1111 77", ["card"]),
            ("3782 822463 10005 12", ["card"]), ("99 4111111111111111 1", ["card"]), (f"{card} 2nd", ["card"]), (f"{card} 2024-01-05", ["card", "date"]),
            (f"{card} 12/05/2020", ["card", "date"]), (f"{iban} KBC", ["iban"]), (f"{iban} BANK OF GENT", ["iban"]), (f"{iban} {card}", ["iban", "card"]),
            (f"{iban} 2024-01-05", ["iban", "date"]), ("1 2 3 4 5 6 7 8 9 10 11 12 13", None), ("1 " * 20000, None), ("1" * 20000, [])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    for r in pii.pseudonymized(d).collect():
        text, kinds = rows[r.doc_id]
        if kinds is not None:
            assert r.kinds == kinds, text
        assert len(r.text) == len(text)
        assert "4111 1111" not in r.text and "5390 0754" not in r.text and "822463" not in r.text and "41111111" not in r.text, (text, r.text)


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><meta charset=utf-8><body><nav>n</nav><article>The story.</article></body></html>", "The story."),
    ("<head><title>t</title><link rel=x><article><p>One.<p>Two.</article>", "One. Two."),
    ("<head><title>t</title>Bare text.", "Bare text."),
    ("<div class='layout has-sidebar'><nav>n</nav><article>The story.</article><div class=sidebar>s</div></div>", "The story."),
    ("<div class='page with-header'><p>line</p><main>The main.</main></div>", "The main."),
    ("<main><p>The main.</p></main><div class=related><article>Teaser.</article></div>", "The main."),
    ("<div class=comments><article class=comment>No.</article></div><p>Plain.</p>", "Plain."),
    ("<div class=has-sidebar><aside><article>Aside.</article></aside><article>The story.</article></div>", "The story."),
])
def test_articles_survive_open_heads_and_named_wrappers(page, text):
    assert html_extraction.main_text(html_extraction.blocks(page), None)[0] == text
