"""Encoding, look-alikes, residue, boilerplate, leaks, personal information on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from adlens.llm import boilerplate as boilerplate_module
from adlens.llm import contamination, mojibake
from adlens.llm import residue as residue_module
from adlens.llm.boilerplate import boilerplate, common_lines, line_key
from adlens.llm.contamination import WuManber, leaked, windows
from adlens.llm.lookalike import respelled
from adlens.llm.markup import shown_lines
from adlens.llm.pii import personal_information, redacted
from adlens.llm.residue import fit, labelled_lines, least_score, residue, residue_vote, scores, trained, validated

ROWS = "src string, rec_id long, text string, status int, url string"


def rows(spark, texts, src="documents", status=None, urls=None):
    data = [(src, i, t, status, urls[i] if urls else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, ROWS).withColumn("key", F.lit("clash")).withColumn("page", F.lit(1)).withColumn("states", F.lit(2))


PL = "Zażółć gęślą jaźń, łódź płynie – „Po prostu trzyma kształt”, mówią żeglarze z Łodzi. Ściółka śpi, ćma leci, księżyc świeci."
CLEAN = [PL, "L’été à la plage, très chaud : « déjà vu » – naïve café.", "Für Größe und Höhe: „schön“, Übung, weiß.", "Plain text only.", "It’s a “quoted” line – the crew’s €5 note.", "20 m³ ± 5 µm and CHÂTEAU LORVÂN"]


def test_encodings_round_trip(spark):
    broken = [(PL, "utf-8", "cp1250"), (PL, "utf-8", "latin-1"), (PL, "cp1250", "latin-1"), (PL, "iso8859-2", "latin-1"), (CLEAN[1], "utf-8", "mac_roman"), (CLEAN[2], "utf-8", "cp437"), (CLEAN[2] * 3, "cp1252", "cp850")]
    texts = [f"{text} {i}" for i in range(12) for text in CLEAN]
    wanted = {}
    for text, written, read in broken:
        bad = "".join(mojibake_char(b, read) for b in text.encode(written, errors="ignore"))
        wanted[len(texts)] = text.encode(written, errors="ignore").decode(written)
        texts.append(bad)
    twice = "".join(mojibake_char(b, "cp1252") for b in "".join(mojibake_char(b, "cp1252") for b in PL.encode()).encode())
    wanted[len(texts)] = PL
    texts += [twice, "Gr�ße und H�he", None, "", "CHÂTEAU LORVÂN – PÃO E MAÇÃ", "20 m³ ± 5 µm", "Văn Phở Đặc Biệt", "ä" * 50_000, twice]
    found = {r["rec_id"]: r for r in mojibake.mojibake(rows(spark, texts)).collect()}
    lost = len(CLEAN) * 12 + len(broken) + 1
    assert set(found) == {*wanted, lost, len(texts) - 1}
    for i, text in wanted.items():
        assert found[i]["restored"] == text and found[i]["restorable"]
    assert not found[lost]["restorable"]
    assert mojibake.mojibake(rows(spark, []).limit(0)).count() == 0
    # Copies vouch for nothing: with every text twenty times the same texts are found.
    again = mojibake.mojibake(rows(spark, texts * 20), restore=False).collect()
    assert {r["rec_id"] % len(texts) for r in again} == set(found) and len(again) == 20 * len(found)


def test_restored_text_differs_in_labelled_runs_only(spark):
    bad = "<p>caf&#233; &#8211; \0 Größe</p>\n<p>fÃ¼r Ã¼ber &#195;&#188;ber &amp; schÃ¶n</p>\n<p>&#8222;gut&#8220; x&#228;y</p>"
    good = "<p>caf&#233; &#8211; \0 Größe</p>\n<p>für über über &amp; schön</p>\n<p>&#8222;gut&#8220; x&#228;y</p>"
    clean = [f"{t} für über schön {i}" for i in range(12) for t in CLEAN]
    found = {r["rec_id"]: r for r in mojibake.mojibake(rows(spark, [*clean, bad, *clean[:3]])).collect()}
    assert set(found) == {len(clean)} and found[len(clean)]["restored"] == good and found[len(clean)]["restorable"]


def mojibake_char(b, encoding):
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def test_inverse_of_references():
    assert mojibake.plain("f&#195;&#188;r &amp; &#65; &#xD800;") == "fÃ¼r &amp; &#65; &#xD800;"
    assert mojibake.inverse("Ã¼", mojibake.STATES.index("utf-8>cp1252")) == "ü" and mojibake.inverse("ü", 1) is None


def test_lookalikes(spark):
    keywords = spark.createDataFrame([(1, "śpiwór dziecięcy"), (2, "oak shelf light"), (3, "плед купить"), (4, "wool blanket 58"), (5, None)], "kw_id long, text string")
    spellings = ["śpiwór dziecięcy", "śpiwór dziecięcy", "oak sһеlf light", "o­ak​ shelf light", "ｏａｋ shelf ｌｉｇｈｔ", "Oak shelf light", "oak shelf", "плед купить", "плeд купить", "wool blanket⁠58", "wool  blanket 58 ", None, "", "x" * 10_000, "spiwor dzieciecy", "oak sһеlf light"]
    texts = spark.createDataFrame([("emb", i, 0, t) for i, t in enumerate(spellings)], "src string, rec_id long, pos int, text string").withColumn("canonical", F.lit("clash"))
    got = {(r["rec_id"], r["kw_id"]) for r in respelled(texts, keywords).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2), (8, 3), (10, 4), (15, 2)} | {(9, 4)} - ({(9, 4)} if "wool blanket⁠58".replace("⁠", "") != "wool blanket 58" else set())
    assert respelled(texts.limit(0), keywords).count() == 0 and respelled(texts, keywords.limit(0)).count() == 0


def brute_leaks(docs, items, n):
    word = contamination.WORD
    out = set()
    for i, t in items:
        w = word.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            for d, text in docs:
                v = word.findall((text or "").lower())
                if any(v[j : j + n] == w[k : k + n] for j in range(len(v) - n + 1)):
                    out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta eps zeta".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    docs += [(50, items[0][1].upper().replace(" ", " –\n")), (51, None), (52, ""), (53, "x " * 20_000 + items[1][1]), (54, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for n in (3, 5):
        want = brute_leaks(docs, items, n)
        for group in (200_000, 5):
            assert {tuple(r) for r in leaked(d, b, n, group).collect()} == want
    assert leaked(d, b.limit(0)).count() == 0 and leaked(d.limit(0), b).count() == 0


def test_wu_manber_block_longer_than_pattern():
    machine = WuManber(windows([(1, " a b c ")], 2))
    assert machine.search(" x a b y ") == {1} and machine.search(" xa b y ") == set() and machine.search("") == set()


PARAS = ["Our team rewrote the page title so that parents find the sturdy camping stove sooner.", "Die Lieferung dauert 12 Werktage, die Rückgabe ist 30 Tage möglich.", "Check that no draft with lorem ipsum goes live before the campaign starts.", "Pages that need JavaScript should still send their title and price in plain markup."]
BAD = ["Error 404: the server could not finish your request.", "Your session has expired. Sign in again to see this page.", "Buy {{product_name}} now and save at %%city%%.", "Please enable JavaScript in your browser to continue.", "Lorem ipsum dolor amet velor quivit ipsum dolor.", "SQLSTATE[HY000]: General error: 326 cannot connect"]


def residue_table(spark):
    good = [f"{PARAS[i % 4]}\n{PARAS[(i + 1) % 4]} No {i}." for i in range(200)]
    texts = good + BAD * 6 + [None, "", PARAS[0] * 3000, "The tag “{KeyWord:lamps}” inserts the query into the headline."]
    return rows(spark, texts), set(range(200, 200 + 36))


def test_residue(spark):
    table, bad = residue_table(spark)
    assert {r["rec_id"] for r in residue(table).collect()} == bad
    assert residue(table.limit(0)).count() == 0
    assert residue(table.filter("rec_id < 2")).count() == 0
    page = "<html><head><title>x</title><script>{{ a }}</script></head><body><noscript>%s</noscript><div id='app'></div></body></html>" % BAD[3]
    mixed = table.unionByName(rows(spark, [page, page.replace("<div", f"<p>{PARAS[0]}</p><div")], "pages", 200))
    assert {r["rec_id"] for r in residue(mixed).filter("src = 'pages'").collect()} == {0}


def test_validation(spark):
    table, _ = residue_table(spark)
    hosts = table.withColumn("url", F.concat(F.lit("https://h"), F.col("rec_id") % 20, F.lit(".example/")))
    r = {x["held_out"]: x for x in validated(hosts).collect()}
    assert r["hosts"]["positive"] > 0 and r["hosts"]["found"] >= 0.8 * r["hosts"]["positive"] and r["hosts"]["wrong"] <= 2
    assert set(r) <= {"hosts", "voters 0", "voters 1", "voters 2"}
    assert validated(hosts.limit(0)).count() == 0


def test_residue_on_unseen_hosts(spark):
    """Trained on one half of the messages' texts, it knows the other half's by their words."""
    table, bad = residue_table(spark)
    lines = labelled_lines(table)
    assert set(lines["label"]) == {True, False}
    rng = random.Random(0)
    held = [rng.random() < 0.3 for _ in range(len(lines))]
    train, test = lines[[not h for h in held]], lines[held]
    z = scores(fit(train), pa.array(test["line"], pa.large_string()), test["first"].to_numpy(bool), test["alone"].to_numpy(bool))
    assert ((z > 0) == test["label"].to_numpy(bool)).mean() > 0.9
    assert residue_vote(BAD[0]) and not residue_vote(PARAS[2])
    known = trained(table)
    assert {r["rec_id"] for r in residue(rows(spark, [BAD[0], PARAS[1], BAD[4]]), weights=known).collect()} == {0, 2}


def test_least_score():
    z, label = np.array([5.0, 4.0, 1.0, 0.5, -1.0]), np.array([True, True, False, True, False])
    assert 1 < least_score(z, label, np.array([1.0, 1, 50, 1, 50])) <= 4  # one sampled line stands for fifty
    assert -1 < least_score(z, label, np.ones(5)) <= 0.5


NAV = ["Skip to content", "Home | Kids | Garden | Help", "Basket (0)"]
FOOT = ["Others looked at", None, None, "Follow us", "© 2024 Shop. All rights reserved."]


def name_of(rng):
    return "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(4)).title()


def page_lines(i, rng):
    crumb = f"Home » Kids » {name_of(rng)} kettle"
    title = f"{name_of(rng)} kettle"
    body = [f"The report on {name_of(rng)} shows {rng.randrange(9999)} clicks on the brass kettle of {name_of(rng)}." for _ in range(2)] + ["holds its colour"] * (i % 7 == 0)
    foot = [x or f"{name_of(rng)} pan" for x in FOOT]
    return [*NAV, crumb, title, *body, *foot], [0, 1, 2, 3, *range(5 + len(body), 5 + len(body) + len(foot))]


def test_boilerplate(spark):
    rng = random.Random(4)
    texts, urls, want = [], [], set()
    for i in range(60):
        lines, off = page_lines(i, rng)
        texts.append("\n".join(lines))
        urls.append(f"https://shop.example/p/kettle-{i:03d}")
        want |= {(i, j) for j in off}
    texts += [None, "", "x", "\n".join(["lonely"] * 3), texts[5]]
    urls += ["https://shop.example/p/z", "https://shop.example/p/zz", None, "https://alone.example/a", urls[5] + "?utm_source=x"]
    want |= {(64, j) for i, j in want if i == 5}
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate(rows(spark, texts, "snapshots", urls=urls)).collect()}
    assert got == want
    assert boilerplate(rows(spark, []).limit(0)).count() == 0


def test_boilerplate_of_a_hot_page(spark, monkeypatch):
    """One page holds most rows, and the pages beside it stand in other blocks."""
    monkeypatch.setattr(boilerplate_module, "BLOCK", 8)
    rng = random.Random(6)
    texts, urls, want = [], [], set()
    for i in range(90):
        lines, off = page_lines(i, rng)
        texts.append("\n".join(["We use cookies to show you pages that you may like.", *lines]))
        urls.append(f"https://shop.example/p/{i if i < 10 else 4:03d}")
        want |= {(i, 0), *((i, j + 1) for j in off)}
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate(rows(spark, texts, "snapshots", urls=urls)).collect()}
    assert got == want


def test_boilerplate_of_two_pages(spark):
    """A host with two pages has one pairing, and it counts."""
    rng = random.Random(8)
    texts, urls, want = [], [], set()
    for i in range(2):
        lines, _ = page_lines(i + 1, rng)
        texts.append("\n".join(lines))
        urls.append(f"https://two.example/p/{i}")
        want |= {(i, lines.index(x)) for x in (*NAV, "Follow us", FOOT[-1])}
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate(rows(spark, texts, "snapshots", urls=urls)).collect()}
    assert want <= got and not any(texts[i].split("\n")[j].startswith("The report") for i, j in got)


def test_boilerplate_of_later_versions(spark):
    """A notice that only the second version of each page shows is a template line."""
    rng = random.Random(9)
    texts, urls, notes = [], [], set()
    for version in range(2):
        for i in range(12):
            lines, _ = page_lines(i + 1, rng)
            note = ["We have moved to a new shop, so please update your bookmarks today."] * version
            notes |= {(len(texts), len(lines))} if version else set()
            texts.append("\n".join([*lines, *note]))
            urls.append(f"https://shop.example/p/{i}")
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate(rows(spark, texts, "snapshots", urls=urls)).collect()}
    assert notes <= got


def test_repeated_lines_are_read_and_scored_once(monkeypatch):
    hashed, scored = [], []
    line_hash, features = boilerplate_module.line_hash, residue_module.features
    monkeypatch.setattr(boilerplate_module, "line_hash", lambda line, plain=None: hashed.append(line) or line_hash(line, plain))
    monkeypatch.setattr(residue_module, "features", lambda lines, first, alone: scored.append(len(lines)) or features(lines, first, alone))
    long = "This notice on cookies – shown on all pages of the shop – is much longer than a menu entry would ever be."
    text = f"{long}\nHome | Shop | Help\n{long}"
    known = boilerplate_module.Known()
    pages = [boilerplate_module.Page.read(text, False, known) for _ in range(5)]
    assert len(hashed) == len(set(hashed)) == 8  # two lines, three parts each
    assert {(tuple(p.keys), p.flags, tuple(p.parts)) for p in pages} == {(tuple(map(line_hash, text.split("\n"))), pages[0].flags, (0, 1, 2))}
    monkeypatch.setattr(boilerplate_module, "ROOM", 300)  # less than the two lines and their parts need
    known = boilerplate_module.Known()
    again = [boilerplate_module.Page.read(text, False, known) for _ in range(5)]
    assert [(p.keys, p.flags, p.parts) for p in again] == [(p.keys, p.flags, p.parts) for p in pages]
    weights = np.random.default_rng(0).normal(size=residue_module.DIM + 1)
    own = text.split("\n") * 4
    first = np.arange(len(own)) % 3 == 0
    z = residue_module.scores(weights, pa.array(own, pa.large_string()), first, np.zeros(len(own), bool))
    assert scored == [3]  # the long line is first in its text or not
    alone = [float(residue_module.scores(weights, pa.array([x], pa.large_string()), first[i : i + 1], np.zeros(1, bool))[0]) for i, x in enumerate(own)]
    assert np.allclose(z, alone, rtol=0, atol=1e-12)


def test_shown_lines_of_tags_over_several_lines():
    page = "<p class='a'>One &amp; two</p>\n<p\n class='b'>Three<br\n/> four</p>\n\xa0Five <b>six</b>\n<!-- no\nno -->seven"
    assert shown_lines(page) == ["One & two", "", "Three", "four", "Five six", "", "seven"]
    assert shown_lines(page.replace("&amp; ", "")) == ["One two", "", "Three", "four", "Five six", "", "seven"]


def test_boilerplate_in_markup(spark):
    rng = random.Random(4)
    texts, urls, want = [], [], set()
    for i in range(40):
        lines, _ = page_lines(i, rng)
        n = len(lines) - 9
        html = ["<html><head>", "<title>t</title>", "</head><body>", '<div class="top">', *[f"<p>{x}</p>" for x in lines[:4]], "</div>", "<main>", f"<h1>{lines[4]}</h1>", *[f"<p>{x}</p>" for x in lines[5 : 4 + n]], "</main>", '<div class="end">', *[f"<li>{x}</li>" for x in lines[4 + n :]], "</div>", "</body></html>"]
        texts.append("\n".join(html))
        urls.append(f"https://shop.example/p/{i:03d}")
        want |= {(i, j) for j, x in enumerate(html) if re.match("<(p|li)>", x) and (j < 8 or x.startswith("<li>"))}
    got = {(r["rec_id"], r["line_no"]) for r in boilerplate(rows(spark, texts, "pages", urls=urls)).collect()}
    assert got == want


def test_common_lines_is_longest():
    rng = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                up = row[j]
                row[j] = left + 1 if x == y else max(up, row[j - 1])
                left = up
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        places = {}
        for j in range(len(b) - 1, -1, -1):
            places.setdefault(b[j], []).append(j)
        assert len(common_lines(a, places)) == lcs(a, b)
    assert line_key("Größe – 12 und 13 cm") == line_key("GrÃ¶ÃŸe â€“ 99 und 1 cm")


def test_personal_information(spark):
    people = [("Edgar", "Tranwick"), ("Hannah", "Marmoor"), ("Ruth", "Thistley"), ("Nora", "Oxgrave"), ("Simon", "Wexcombe")]
    texts = []
    for i in range(40):
        g, s = people[i % 5]
        texts.append(f"You can reach {g} {s}{i} at {g.lower()}.{s.lower()}{i}@mail.example until Friday.".replace(f"{s}{i} at", f"{s} at"))
        texts.append(f"Customer {g} {s} confirmed the refund; the identity number on file is {900 + i}-12-34{i:02d}.")
        texts.append(f"Please call me on +44 7700 9001{i:02d} or write to x{i} (at) mail.example.")
        texts.append(f"Please call me on 07700 9002{i:02d} or later.")
        texts.append(f"The parcel should go to {i + 1} Mill Copse Lane, Marlow Cross.")
    texts += ["Order ZK-60699140, article code 8799137392098, version 5.22.2.94.", None, "", "Follow @bara_pizo and use #tuwo40.", "word " * 20_000 + "Please call me on 07700 900999 or later.", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("pattern", F.lit(1))
    got = {}
    for r in personal_information(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["pii_kind"], texts[r["doc_id"]][r["start_at"] : r["end_at"]]))
    assert got[0] == got[205] == {("name", "Edgar Tranwick"), ("email", "edgar.tranwick0@mail.example")}
    assert got[1] == {("name", "Edgar Tranwick"), ("id_number", "900-12-3400")}
    assert got[2] == {("phone", "+44 7700 900100"), ("email", "x0 (at) mail.example")} and got[3] == {("phone", "07700 900200")}
    assert got[4] == {("address", "1 Mill Copse Lane, Marlow Cross")} and got[204] == {("phone", "07700 900999")}
    assert not {200, 201, 202, 203} & set(got)
    plain = {r["doc_id"]: r["text"] for r in redacted(df).collect()}
    assert plain[0] == "You can reach <NAME> at <EMAIL> until Friday." and plain[201] is None and plain[202] == "" and plain[200] == texts[200]
    assert personal_information(df.limit(0)).count() == 0


def test_copies_lose_no_person(spark):
    """A number shape is mostly met in other contexts, but stands behind a sure one; more rows and copies change nothing."""
    texts = [f"Please call me on 0{i % 7}700 9002{i:02d} today." for i in range(60)] + [f"Please call me on +44 7700 9001{i:02d} today." for i in range(30)]
    texts += ["Please call me on 99/123/45/67 today.", *(f"{word} 99/123/45/6{i} was sent." for i, word in enumerate(("parcel", "voucher", "article", "batch")))]
    for times in (1, 2, 4):
        df = spark.createDataFrame(list(enumerate(texts * times)), "doc_id long, text string")
        got = {(r["doc_id"] % len(texts), r["pii_kind"]) for r in personal_information(df).collect()}
        assert (90, "phone") in got and not {i for i, _ in got} & {91, 92, 93, 94}
