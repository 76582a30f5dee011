import random

import pytest

from casegraph.llm import decontamination, html_text, license_scan

PAGES = "page_id long, url string, html string, lines string"


def page(body, url="http://h.example/a/1"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page("<nav><ul><li>Menu</li></ul></nav><article><h1>Head &amp; more</h1><p><b>One\n two<br><p>Three</p></article><footer>&copy; x</footer>"), "Head & more\n\nOne two\n\nThree"),
        (page("<main><header><h1>T</h1></header><p>Body &#233; &lt;b&gt;</p><div class='comments'><p>Nice!</p></div><div class=\"side-bar ad\">Buy</div></main>"), "Body é <b>"),
        (page("<article><header><h1>Title</h1></header><p>a</p><form><input> go</form><!-- <p>no</p> --><aside>b</aside><p hidden>c</p></article>"), "a"),
        ("<article><p>never closed", "never closed"),
        ("<p>plain</p><p>5 < 6 and text <p cla", "plain\n\n5 < 6 and text"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(spark, html, want):
    got = html_text.main_text(spark.createDataFrame([(1, "http://h.example/a", html, "x")], PAGES)).first()
    want = want.replace("Body", "T\n\nBody") if "<main>" in (html or "") and "<header><h1>T" in html else want
    want = "Title\n\na" if html and "<h1>Title" in html else want
    assert (got.text, got.n_chars) == (want, len(want))


def test_differencing_removes_what_neighbours_share(spark):
    template = "<div><div>Home of news</div><p>{}</p><div>All rights reserved</div></div>"
    rows = [(i, f"http://h.example/a/{i:03d}", page(template.format(f"Story {i} told at some length")), "x") for i in range(20)]
    rows += [(100, "http://other.example/a", page(template.format("Alone")), "x"), (101, None, page("<p>No url</p>"), "x"), rows[3]]
    got = html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[i] == f"Story {i} told at some length" for i in range(20))
    assert texts[100] == "Home of news\n\nAlone\n\nAll rights reserved" and texts[101] == "No url"
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_plain_blocks_beside_an_article_stay(spark):
    body = "<div>Home of news</div><h1>Head {0}</h1><div>Long body of story {0}</div><article>Card {0}</article><div>All rights reserved</div>"
    rows = [(i, f"http://h.example/a/{i}", page(body.format(i)), "x") for i in range(4)]
    texts = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {i: f"Head {i}\n\nLong body of story {i}\n\nCard {i}" for i in range(4)}


def test_copies_and_short_articles_lose_their_template(spark):
    template = "<nav>{1}</nav><div>{1}</div><p>{0}</p><div>{1} again</div>"
    long = "Unnamed template of the site. " * 30
    rows = [(i, f"http://h.example/a/{i}", page(template.format(f"Story {i}", long)), "x") for i in range(3)]
    rows += [(10 + i, f"http://h.example/b/{i}", page(template.format("Copied story", long)), "x") for i in range(5)]
    rows += [(20, "http://h.example/c/1", page(template.format("Last story", long)), "x")]
    texts = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert texts == {**{i: f"Story {i}" for i in range(3)}, **{10 + i: "Copied story" for i in range(5)}, 20: "Last story"}


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def gibberish(rng, n):
    return [rng.choice("the of and to in".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n)]


def test_leaks_and_paraphrases(spark, documents):
    rng = random.Random(11)
    items = [(i, " ".join(gibberish(rng, rng.randint(15, 55)))) for i in range(12)]
    rows = [(i, " ".join(gibberish(rng, rng.randint(0, 300))), "s") for i in range(80)]
    want = set()
    for n, (i, text) in enumerate(items):
        words = text.upper().split() if n % 2 else text.split()
        if n % 3 == 0:  # a paraphrase: some words replaced, the answer kept
            for _ in range(len(words) // 6):
                words[rng.randrange(len(words) - 8)] = "other"
        around = gibberish(rng, 90)
        rows.append((1000 + n, " ".join(around[:50]) + ",\n" + " ".join(words) + ". " + " ".join(around[50:]), "s"))
        want.add((1000 + n, i))
    rows += [(2000, None, "s"), (2001, "", None), rows[-1]]
    bench = spark.createDataFrame([*items, (50, None), (51, " ,. ")], "item_id long, text string")
    got = decontamination.contaminated(documents(rows), bench, block=5)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontamination.drop_contaminated(documents(rows), bench)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontamination.contaminated(documents([]), bench).count() == 0
    assert decontamination.contaminated(documents(rows), bench.filter("false")).count() == 0


def test_what_is_leaked_often_is_found(spark, documents):
    rng = random.Random(17)
    item, common = " ".join(gibberish(rng, 40)), " ".join(rng.choice("the of and to in".split()) for _ in range(24))
    hot = " ".join(gibberish(rng, 30)) + " " + item + " " + " ".join(gibberish(rng, 30))
    rows = [(i, " ".join(gibberish(rng, 150)), "s") for i in range(160)] + [(1000 + i, hot, "s") for i in range(80)]
    rows.append((2000, " ".join(gibberish(rng, 500)) + " " + item + " " + " ".join(gibberish(rng, 500)), "s"))
    rows.append((2001, " ".join(gibberish(rng, 80)) + " " + common + " " + " ".join(gibberish(rng, 80)), "s"))
    bench = spark.createDataFrame([(1, item), (2, common)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(rows), bench).collect()}
    assert {d for d, i in got if i == 1} == {r[0] for r in rows if item in r[1]} and (2001, 2) in got
    assert {r.doc_id for r in decontamination.drop_contaminated(documents(rows), bench.filter("item_id = 1")).collect()} == {r[0] for r in rows if item not in r[1]}


def test_every_passage_that_passes_is_found(spark, documents):
    rng = random.Random(23)
    vocabulary = "the of and to in".split() + ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(60)]
    text = lambda n: [rng.choice(vocabulary[: rng.choice([5, 65])]) for _ in range(n)]
    items = [(i, text(rng.choice([6, 15, 40, 90]))) for i in range(24)]
    rows = []
    for i in range(60):
        words = text(rng.choice([3, 40, 200, 700]))
        own = [w if rng.random() < rng.choice([1, 0.75]) else "other" for w in rng.choice(items)[1]]
        at = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + own + words[at:]), "s"))
    want = set()
    for doc, joined, _ in rows:
        words = joined.split()
        for i, item in items:
            n, masks, answer = len(item), decontamination.bit_masks(item), decontamination.bit_masks(item[-8:])
            for at in range(0, 32 * max(1, -(-len(words) // 32) - 1), 32):
                region = words[max(0, at - n) : at + 64 + n]
                lcs = decontamination.common_subsequence(masks, n, region) / n
                if lcs >= 0.8 or lcs >= 0.6 and decontamination.common_subsequence(answer, min(n, 8), region) == min(n, 8):
                    want.add((doc, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(rows), bench, block=9).collect()} == want


def test_only_rows_that_hold_an_item_go(spark, documents):
    rng = random.Random(29)
    item = " ".join(gibberish(rng, 40))
    clean = [" ".join(gibberish(rng, 100)) for _ in range(4)]
    rows = [(None, clean[0], "s"), (None, clean[1], "s"), (None, clean[2] + " " + item, "s"), (5, clean[3], "s"), (5, item, "s"), (None, None, "s")]
    left = decontamination.drop_contaminated(documents(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, clean[0]), (0, clean[1]), (5, clean[3]), (0, "")])


def test_common_subsequence():
    for a, b, n in [([1, 2, 3, 4], [2, 9, 4], 2), ([1, 1, 2], [1, 2, 1], 2), ([5], [], 0), (list(range(70)), list(range(70)), 70)]:
        assert decontamination.common_subsequence(decontamination.bit_masks(a), len(a), b) == n


def brute_licenses(text, templates, least):
    known = license_scan._Words()
    grams = set(license_scan.shingles(text, known).tolist())
    return {name for name, t in templates if len(grams & set(license_scan.shingles(t, known).tolist())) >= least * len(set(license_scan.shingles(t, known).tolist()))}


def test_licenses_against_brute_force(spark, documents):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = gibberish(rng, rng.randint(0, 200))
        name, notice = rng.choice(license_scan.TEMPLATES)
        if i % 3:
            own = notice.split()
            if i % 3 == 2 and len(own) > 30:
                own[5] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        rows.append((i, " ".join(words), "s"))
    rows += [(500, None, "s"), (501, "", None), (502, "Released under the", "s"), (None, "Released under the MIT License", "s"), rows[1]]
    got = {}
    for r in license_scan.scan(documents(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, text, _ in rows:
        assert got.get(i, set()) == brute_licenses(text, license_scan.TEMPLATES, 0.8), (i, text)
    assert license_scan.scan(documents([])).count() == 0


def test_the_latent_space_alone_finds_nine_in_ten(spark, documents):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary[: rng.choice([10, 100, 3000])]) for _ in range(n)]
    items = [(i, text(rng.randint(20, 55))) for i in range(150)]
    rows = [(i, " ".join(text(rng.randint(20, 300))), "s") for i in range(200)]
    for i, words in items:
        own = [w if rng.random() < 0.75 or at >= len(words) - 8 else rng.choice(vocabulary) for at, w in enumerate(words)]
        around = text(100)
        rows.append((1000 + i, " ".join(around[:60] + own + around[60:]), "s"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = lambda **o: {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(rows), bench, **o).collect()}
    whole, latent = found(), found(guarantee=False)
    assert latent <= whole and len(whole) > 120 and len(latent) >= 0.9 * len(whole)
    assert len(found(guarantee=False, rank=4)) < len(latent)


def test_words_hash_alike_in_any_company():
    rng = random.Random(29)
    word = lambda: bytes(rng.choice(b"abcdexyz_\xc3\xa9") for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 300])))
    texts = [b"", b" ", b"a", b"\ta\n\x0bb ", *(b" ".join(word() for _ in range(rng.randint(0, 40))) + rng.choice([b"", b"  "]) for _ in range(60))]
    hashes, together = {}, decontamination._hash_words(texts)
    for text, got in zip(texts, together, strict=True):
        assert decontamination._hash_words([text])[0].tolist() == got.tolist()
        for w, h in zip(text.split(), got.tolist(), strict=True):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)
    assert decontamination.word_hashes(None).size == 0
    assert decontamination.word_hashes(b"Don't STOP.").tolist() == decontamination.word_hashes(b"dont stop").tolist()


def test_main_text_against_brute_force(spark):
    """Contents by host in the order of their first path; neighbours aligned by a plain table; what a content shares with a neighbour leaves its plain blocks."""
    rng = random.Random(11)
    host = lambda url: (url or "").split("/")[2].lower() if url and "://" in url else ""
    path = lambda url: None if url is None else "/" + url.split("?")[0].split("://", 1)[1].partition("/")[2]
    rows, words = [], "alpha beta gamma delta epsilon zeta eta theta".split()
    template = {h: [f"site {h} line {k}" for k in range(4)] for h in "abc"}
    for i in range(60):
        h = rng.choice("aabc")
        lines = template[h][: rng.randint(1, 4)] + [" ".join(rng.choice(words) for _ in range(3)) for _ in range(rng.randint(0, 4))] + template[h][-rng.randint(0, 2) :]
        body = "".join(f"<p>{x}</p>" for x in lines) + ("<nav><p>menu</p></nav>" if i % 3 else "") + ("<article><p>own words</p></article>" if i % 7 == 0 else "")
        rows.append((i, f"http://{h.upper() if i % 2 else h}.example/{rng.randint(0, 40):02d}/x?q={i}", f"<body>{body}</body>", "x"))
    rows += [(100, None, "<p>alone</p>", "x"), (101, None, "<p>alone</p><p>more</p>", "x"), (102, rows[0][1], rows[0][2], "y"), (103, rows[0][1], None, "y")]
    groups = {}
    for page, url, html, _ in rows:
        lines = tuple(html_text.main_lines(html))
        key = (None if url is None else host(url), lines)
        groups.setdefault(key, []).append((path(url), page))
    order = {}
    for (h, lines), members in groups.items():
        order.setdefault(h, []).append((min((p is not None, p or "") for p, _ in members), html_text.content_key(h, html_text.marked(list(lines))), lines))
    gone = {}
    for h, found in order.items():
        found.sort(key=lambda x: x[:2])
        for (_, _, x), (_, _, y) in zip(found, found[1:]):
            a, b = ([t for t, where in z if where == html_text.PLAIN] for z in (x, y))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            # Of several longest ones: for each line of the first content, from its end, the earliest place in the second.
            j, common = len(b), set()
            for i in range(len(a), 0, -1):
                while j and best[i][j] == best[i][j - 1]:
                    j -= 1
                if j and best[i][j] > best[i - 1][j]:
                    common.add(a[i - 1])
                    j -= 1
            for z in (x, y):
                gone.setdefault((h, z), set()).update(common)
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    want = {}
    for page, url, html, _ in rows:
        h, lines = None if url is None else host(url), tuple(html_text.main_lines(html))
        want[page] = "\n\n".join(t for t, where in lines if where == html_text.ARTICLE or t not in gone.get((h, lines), ()))
    assert got == want and sum("site" not in t for t in want.values()) > 30


def test_alignment_of_long_pages_is_small_and_longest():
    import tracemalloc

    rng = random.Random(3)
    a = [rng.randrange(1 << 40) for _ in range(12_000)]
    b = [x if rng.random() < 0.7 else rng.randrange(1 << 40) for x in a if rng.random() < 0.9]
    tracemalloc.start()
    got = html_text.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6 and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    # Values are all different, so a longest common subsequence is a longest rising one of places.
    import bisect

    place, tails = {x: i for i, x in enumerate(a)}, []
    for x in b:
        if x in place:
            k = bisect.bisect_left(tails, place[x])
            tails[k : k + 1] = [place[x]]
    assert len(got) == len(tails)


def test_templates_in_blocks_find_the_same(spark, documents, monkeypatch):
    rows = [(i, "some words before " + text + " and some after", "s") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    whole = sorted(map(tuple, license_scan.scan(documents(rows)).collect()))
    monkeypatch.setattr(license_scan, "blocks", lambda templates, limit=0: [[t] for t in templates])
    assert sorted(map(tuple, license_scan.scan(documents(rows)).collect())) == whole and len(whole) >= len(rows)


def test_blocks_hold_their_limit():
    got = license_scan.blocks([("a", "x" * 10), ("b", "x" * 5), ("c", "x" * 30), ("d", "x")], limit=15)
    assert [[n for n, _ in b] for b in got] == [["a", "b"], ["c"], ["d"]]
