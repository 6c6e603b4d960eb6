"""Corpus operators against brute force, on edge cases and planted ones."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismatica.llm import queries as Q
from prismatica.llm.backoff_lm import backoff_scores
from prismatica.llm.components import components
from prismatica.llm.decontaminate import NUMBER, NUMBER_WORDS, UNITS, contaminated
from prismatica.llm.induced import sorted_suffixes
from prismatica.llm.licenses import license_scan
from prismatica.llm.common import dealt, labelled
from prismatica.llm.lz_fingerprint import edited_likeness, likeness, ranged
from prismatica.llm.main_text import TEXT_ELEMENTS, _digest, blocks, main_text, templates
from prismatica.llm.near_dedup import near_duplicates
from prismatica.llm.pieces import MARK, Encoder, decoded, encoded, load_pieces
from prismatica.llm.quality_rank import ranked_quality, train_ranking
from prismatica.llm.span_dedup import repeated_spans
from prismatica.llm.toxicity import chain_scores, train_chain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, component long, score int"


def documents(spark, texts):
    """Rows with columns whose names clash with working ones."""
    rows = [(k, t, "en", "s", len(t or ""), "x", 7, 1) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return documents(spark, [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two three four five six"),
                             (7, "one two three four five six"), (8, long), (9, "naïve café 🙂 " + MARK)])


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [(1, "x")]).limit(0)


def words(text):
    return (text or "").encode().lower().split()


def test_suffix_order_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(300):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        order, common = sorted_suffixes(raw, 12, held=20)
        heads = [raw[i:i + 12] for i in order]
        assert sorted(order.tolist()) == list(range(len(raw))) and heads == sorted(heads)
        for k in range(1, len(raw)):
            same = next((n for n, (x, y) in enumerate(zip(heads[k - 1], heads[k])) if x != y), min(len(heads[k - 1]), len(heads[k])))
            assert common[k] == same or same == min(len(heads[k - 1]), len(heads[k])) <= common[k]


def cut_by_brute_force(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeated_spans(spark, odd, none):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, twice = line(320), line(230)
    texts = [line(90) + shared + line(100), shared, line(500), twice + line(40) + twice, line(199), "ab" * 400, None, "", line(30) + shared[40:] + line(9)]
    texts += [texts[2]] * 2 + [texts[4]]
    found = repeated_spans(documents(spark, list(enumerate(texts))), share_mb=1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == cut_by_brute_force(texts)
    assert repeated_spans(odd).count() == odd.count() and repeated_spans(none).count() == 0
    assert {"id", "component"} <= set(repeated_spans(odd).columns)


def test_near_duplicates(spark, odd, none, sf_dir):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = [" ".join(base)]
    for k in range(40):  # a chain in which each is near the one before only
        base = base[:k * 3] + [f"n{k}"] + base[k * 3 + 1:]
        texts.append(" ".join(base))
    texts += [" ".join(f"z{rng.randint(0, 500)}" for _ in range(100)) for _ in range(5)] + [texts[0]] * 3
    sets = [frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) for w in map(words, texts)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == label
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(odd, width=3, percent=85).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (7, 4, 7), (None, 4, None)} <= rows
    assert near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400, k) for k in range(401, 460)] + [(9, 9)]
    label = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_backoff_scores(spark, sf_dir, odd, none):
    from pyspark.sql import functions as F
    docs = Q.table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_backoff_lm"](spark, sf_dir).collect()}
    rows = {r["doc_id"]: [*words(r["text"]), b" "] for r in docs.collect()}
    single, double, starts = collections.Counter(), collections.Counter(), 0
    for k, t in rows.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            single.update(t)
            double.update(zip([b"\t", *t], t))
            starts += 1
    total, distinct = sum(single.values()), len(single)
    counts = single | collections.Counter({b"\t": starts})
    for k, t in rows.items():
        plain = [(single[w] + 1) / (total + distinct + 1) for w in t]
        score = sum(math.log10((double[h, w] + 64 * p) / (counts[h] + 64)) for h, w, p in zip([b"\t", *t], t, plain))
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(single[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(map(math.log10, plain)), rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert backoff_scores(odd, F.lit(True)).count() == odd.count() and backoff_scores(none, F.lit(True)).count() == 0
    assert {r["score"] for r in backoff_scores(odd.limit(1), F.lit(False)).collect()} == {0.0}


def test_licenses(spark, odd, none):
    docs = documents(spark, [(1, "Under the  MIT license, under-the-mit-license"), (2, "cc by by nc cc BY nc"), (3, "under the mit licensed"), (4, None),
                             (5, "This work, as is, is licensed under a Creative Commons Attribution Noncommercial 4.0 International license!")])
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan(docs).collect()}
    assert got[1][:6] == (8, 2, 0, 4, "mit", "mit") and got[2][1:6] == (1, 4, 4, "cc-by-nc", "cc-by-nc")
    assert got[3][1:6] == (0, None, None, "", "") and got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][4:6] == ("", "cc-by-nc") and 0.8 <= got[5][6] < 1
    assert license_scan(odd).count() == odd.count() and license_scan(none).count() == 0
    plan = license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination(spark, odd, none):
    item = "so Alice Smith buys 12 apples for 3 dollars, and then Bob eats 5 apples while Alice sleeps at home today"
    items = spark.createDataFrame([(1, item), (2, "tiny"), (3, None)], "item_id int, text string")
    docs = documents(spark, [(1, f"Some words first. {item} and more"), (2, item.replace("Alice", "Carol").replace("12", "99").replace("5", "4")),
                             (3, item.replace("Alice Smith", "Carol Smith")), (4, "nothing of the kind here at all"), (5, None)])
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): False, (2, 1): True}  # in 3 one name stands for two
    assert contaminated(odd, items).count() == 0 and contaminated(none, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def best_score(vocabulary, text):
    s = MARK + text.replace(" ", MARK)
    literal = {i + 1 for i, c in enumerate(text) if c == MARK}
    best = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        ends = [n for n in range(1, 17) if i + n <= len(s) and not literal & set(range(i, i + n)) and s[i:i + n] in vocabulary["plain"]]
        for n in ends:
            best[i + n] = max(best[i + n], best[i] + vocabulary["plain"][s[i:i + n]][0])
        if 1 not in ends:
            best[i + 1] = max(best[i + 1], best[i] + vocabulary["byte_score"] * len(s[i].encode()))
    return best[-1]


def test_pieces(spark, odd, none):
    vocabulary = load_pieces()
    encoder, rng = Encoder(vocabulary), random.Random(4)
    value = {i: s for s, i in vocabulary["plain"].values()}
    for _ in range(300):
        text = "".join(rng.choice("aabcdehlot \n▁é🙂  世ing") for _ in range(rng.randint(1, 80)))
        ids = encoder.encode(text).tolist()
        assert encoder.decode(ids) == text
        assert math.isclose(sum(value.get(i, vocabulary["byte_score"]) for i in ids), best_score(vocabulary, text), rel_tol=1e-9)
    long = "ab" * 5000  # no word mark: ids become final where all paths meet
    assert len(list(encoder.stream(MARK + long))) > 10 and encoder.decode(encoder.encode(long).tolist()) == long
    rows = encoded(odd, vocabulary)
    assert rows.filter("not same").count() == 0 and rows.count() == odd.count() and encoded(none, vocabulary).count() == 0
    back = decoded(rows, vocabulary).filter("doc_id = 9").first()
    assert back["text"] == "naïve café 🙂 " + MARK


def test_classifiers(spark, odd, none):
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(["sun", "moon", "river", "stone", "bird", "leaf"]) for _ in range(30))
    rows = [(k, plain() + (" vilest wretch" if k % 4 == 0 else "") if k % 5 else plain().upper() + " !!! !!!") for k in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 5 > 0), int(k % 4 == 0 and k % 5 > 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    models = train_chain(docs, labels, Q.TOXICITY)
    assert len(models[1]["earlier"]) == 1 and models[0]["earlier"] == []
    found = {r["doc_id"]: r["probabilities"][1] >= 0.5 for r in chain_scores(docs, models, carry=["doc_id"]).collect()}
    assert sum(found[k] == (k % 4 == 0 and k % 5 > 0) for k in found) >= 396
    model = train_ranking(docs, labels)
    good = {r["doc_id"]: r["score"] >= 0.5 for r in ranked_quality(docs, model, carry=["doc_id"]).collect()}
    assert sum(good[k] == (k % 5 > 0) for k in good) >= 396
    for frame in (odd, none):
        assert chain_scores(frame, models).count() == frame.count() == ranked_quality(frame, model).count()
    assert train_chain(none, labels, Q.TOXICITY)[1]["bias"] == 0.0 and train_ranking(docs, labels.limit(0))["threshold"] == 0.0


def test_fingerprints(spark, odd, none):
    docs = documents(spark, [(3, "abcd" * 30), (1, "xyzzy plugh " * 9), (2, "abcd" * 30), (5, None)])
    got = {r["doc_id"]: r for r in edited_likeness(docs).collect()}
    assert got[2]["near_next"] == 1.0 and got[2]["fingerprint"] == got[3]["fingerprint"]
    edited = ("abcd" * 30)[:90] + ("xyzzy plugh " * 9)[:0] + ""
    assert got[3]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[5]["n_chars"] == 0
    assert edited_likeness(odd).count() == odd.count() and edited_likeness(none).count() == 0
    assert likeness(np.array([1, 2]), np.array([2, 3])) == pytest.approx(1 / 3)


def test_main_text(spark):
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>Accept</div>"
            "<article><h1>Head {0}</h1><p><b>Fish &amp; chips {0}<br>twice<p>Second<script>'</p>'</script><div class='comments'><p>Nice!</p></div>"
            "<form>Mail</form><p>Last &#233;</p></article><aside>More</aside><footer>c</footer></body></html>")
    rows = [(i, f"https://h.example/{i}", page.replace("{0}", str(i)), "x") for i in range(8)] + [(20, None, None, "x"), (21, "odd", "", "x"), (22, "//a.b/c", "<p>only", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    assert got[3]["text"] == "Head 3\nFish & chips 3 twice\nSecond\nLast é" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "only"
    assert {r["host"]: r["slot"] for r in templates(pages.filter("html is not null")).collect()}["h.example"] == "/html/body/article"
    assert main_text(pages.limit(0)).count() == 0
    assert [b[3] for b in blocks("1 < 2 &lt; 3") if not b[2]] == ["1 < 2 < 3"]


def kept_blocks(page):
    return [b[3] for b in blocks(page) if not b[2] and not b[1]]


def test_inline_furniture_ends_at_its_tag(spark):
    page = ("<html><body><a class='skip-link' href='#c'>Skip</a><article><p>One <span class='share-count'><span>3</span> shares</span> two"
            "<p>Three <a id='comment-5'></a>four</p><span class='ad'><div>Buy</span></div><p>Five</p></article><p>Six</body></html>")
    assert kept_blocks(page) == ["One two", "Three four", "Five", "Six"]
    assert kept_blocks("<span class='ad'>x</span>a <b>b <i class='ad'>y</b> c</p><p>d") == ["a b c", "d"]
    pages = spark.createDataFrame([(i, f"https://s.example/{i}", page.replace("Five", f"Five {i}")) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text(pages).collect()} == {f"One two\nThree four\nFive {i}" for i in range(6)}


def test_wrappers_are_no_furniture(spark):
    body = "<nav><p>Menu of it</p></nav>{0}<article><h1>Head</h1><p>Body text 1</p><div class='comments'><p>Nice, a long comment this is</p></div></article>{1}"
    for opened, closed in (("<div class='layout has-sidebar'>", "</div>"), ("<div id='page' class='with-header'>", "</div>"), ("<div class='sidebar'>", "</div>"),
                           ("<section class='related-work'>", "</section>"), ("<p class='ad-hoc'>", ""), ("<form>", "</form>"), ("<div id='header'><div class='skip'>", "</div></div>")):
        assert kept_blocks(body.format(opened, closed)) == ["Head", "Body text 1"], opened
    assert kept_blocks("<form><nav>a</nav><div><p>The text of the page</p></div></form>") == ["The text of the page"]
    assert kept_blocks("<main><h1>Head</h1><form><p>The text of the page</p></form></main>") == ["Head", "The text of the page"]
    assert kept_blocks("<div>The text of the page</div><aside><article>Card</article></aside><div class='share-buttons'>Tell</div>") == ["The text of the page"]
    page = "<html><body><form><div class='sidebar'>Menu</div><div class='main-column'><p>Text {0} of the page</p></div></form></body></html>"
    pages = spark.createDataFrame([(i, f"https://w.example/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text(pages).collect()} == {f"Text {i} of the page" for i in range(6)}


def test_repeats_of_a_page_are_no_template(spark):
    rows = [(i, "https://one.example/", "<html><body><p>All of it</p></body></html>") for i in range(25)]
    assert {r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"All of it"}


def test_a_common_key_is_dealt_out(spark):
    """A third of the rows share a key, a third have none."""
    docs = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN id WHEN 1 THEN 900 END AS doc_id", "concat('text ', id) AS text")
    sizes = [r["count"] for r in docs.groupBy(dealt(F.col("doc_id"), F.col("text"), 30)).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200
    source = docs.select(F.col("doc_id").alias("id"), "text")
    found = ranged(source, 30).groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("id", F.lit(-1)), F.xxhash64("text"))).alias("a"),
                                                   F.max(F.struct(F.coalesce("id", F.lit(-1)), F.xxhash64("text"))).alias("z")).orderBy("part").collect()
    assert len(found) >= 28 and max(r["n"] for r in found) < 300 and all(a["z"] < b["a"] for a, b in zip(found, found[1:]))


def test_decontamination_by_text(spark):
    """Rows that share a key, or have none, are matched one by one."""
    item = "A farmer sells 12 boxes of ripe apples to the market and 30 sacks of old grain to Anna before the rain starts to fall again"
    other, w = item.replace("12", "17").replace("30", "44"), item.split()
    halves = [" ".join(w[:14]), " ".join(w[10:])]
    docs = spark.createDataFrame([(k, t) for k in (1, None) for t in (item, other)] + [(2, t) for t in halves] + [(3, other), (3, other)], "doc_id long, text string")
    got = {(r["doc_id"], r["changed"]) for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(1, True), (None, True), (3, True)}


def test_short_items(spark):
    """Items without windows, or with few, at the start and in the middle of a sentence."""
    items = {1: "Who wrote Hamlet?", 2: "12 + 30 = 42", 3: "How many legs has a spider?", 4: "Anna Berg, 12 km, 7 kg, 30 Oslo Street",
             5: "Solve the equation for 7 apples", 6: "Name the largest planet of all", 7: "..."}
    texts = [(i, f"{lead}{t} and then some") for i, t in items.items() if i < 7 for lead in ("", "he asked me ", "Once. ")]
    texts += [(10, "so solve the equation for 9 apples"), (11, "who wrote Macbeth"), (12, "the largest planet of them all"), (13, "...")]
    docs, benchmark = spark.createDataFrame([(k * 100 + n, t) for n, (k, t) in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame(
        list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["changed"]) for r in contaminated(docs, benchmark).collect()}
    assert got == {(k * 100 + n, k, False) for n, (k, t) in enumerate(texts) if k < 7} | {(1018, 5, True), (1119, 1, True)}


@pytest.mark.parametrize("words", [8, 12, 20, 40])
def test_items_in_other_letter_case(spark, words):
    """Copies of an item with names and numbers, whatever its length and the case of their letters."""
    item = " ".join(("Then Anna Berg sells 12 boxes of ripe apples to Bob Lind at 30 cents and the people of Oslo walk home before "
                     "Carl has counted 7 sacks of old grain for his aunt Dora in the small town of Bergen by night").split()[:words])
    changed = item.replace("12", "19").replace("Anna", "Wilma")
    docs = spark.createDataFrame(enumerate([item, item.lower(), item.upper(), item.title(), f"They say: {item.lower()} or so", changed,
                                            "Anna Berg sells apples and Bob Lind walks home"]), "doc_id long, text string")
    got = {(r["doc_id"], r["changed"]) for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(i, False) for i in range(5)} | {(5, True)}


def test_item_ids_null_and_repeated(spark):
    short = "how many ripe apples does one farmer sell to his old neighbour today"
    far = " ".join(f"word{i} of{i}" for i in range(30))
    docs = spark.createDataFrame([(1, short), (2, far), (None, short), (3, "nothing at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, short), (7, far), (None, short), (7, short), (9, short), (8, None), (8, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["share"], r["windows"]) for r in contaminated(docs, items).collect()}
    assert got == {(d, i, 1.0, 9) for d in (1, None) for i in (7, None, 9)} | {(2, 7, 1.0, 56)}


def test_names_stay_apart_and_numbers_may_meet(spark):
    item = "today Alice sells 12 big red apples and later in the day Bob buys 30 small green pears from the shop"
    docs = spark.createDataFrame([(1, item.replace("Alice", "Carol").replace("Bob", "Carol")), (2, item.replace("Alice", "Carol")),
                                  (3, item.replace("30", "12")), (4, item.replace("Alice", "Bob").replace("Bob buys", "Alice buys"))], "doc_id long, text string")
    got = {r["doc_id"] for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {2, 3, 4}


def plain_windows(text, item):
    """Template windows by the definitions, word by word: {place: [(template, values)]}."""
    raw = [(w, w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡")) for w in (text or "").split()]
    raw = [(w, b) for w, b in raw if b]
    kinds = []
    for i, (w, b) in enumerate(raw):
        low = b.lower()
        if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kinds.append("number")
        elif low in UNITS and i and kinds[-1] == "number":
            kinds.append("unit")
        else:
            open_sentence = i == 0 or not (raw[i - 1][0][-1].isalnum() or raw[i - 1][0][-1] in ",'’)")
            capital = b[0].isupper() and not b.isupper()
            kinds.append("first" if capital and i == 0 else "name" if capital and not open_sentence else "word")
    out = {}
    for at in range(len(raw) - 4):
        options = []
        for names in ({"name"}, {"name", "first"}, set()) if item else ({"name"}, set()):
            k = [x if x in ("number", "unit") or x in names else "word" for x in kinds[at:at + 5]]
            k = ["name" if x == "first" else x for x in k]
            if k.count("word") >= 2:
                low = [b.lower() for _, b in raw[at:at + 5]]
                options.append((names, tuple(f"<{x}>" if x != "word" else w for x, w in zip(k, low)),
                                tuple((x, w) for x, w in zip(k, low) if x != "word")))
        if options and (not item or any(names for names, _, _ in options)):
            out[at] = [o[1:] for o in options]
    return out


def test_decontamination_by_brute_force(spark, sf_dir):
    """All pairs of a document and an item, diagonal by diagonal, on texts made of a few words."""
    rng = np.random.default_rng(3)
    words = "red cat the of Anna Bob 12 7 km runs. home and, blue tree Oslo 3 kg".split()
    some = lambda n: " ".join(rng.choice(words, n))
    items = [(i, some(12)) for i in range(12)]
    texts = [some(60) for _ in range(150)]
    for j in range(0, 150, 2):
        hold = items[j % 12][1]
        swap = (str, str.lower, lambda t: t.replace("Anna", "Carl").replace("12", "99"), lambda t: t.replace("Bob", "Anna"), str.title)[j % 5]
        texts[j] = f"{texts[j]} {swap(hold)} {some(20)}"
    docs = [(j, t) for j, t in enumerate(texts)]
    want = {}
    parts = {i: plain_windows(t, True) for i, t in items}
    assert all(parts.values())
    for j, t in docs:
        held = plain_windows(t, False)
        for i, windows in parts.items():
            lines = {}
            for at, options in windows.items():
                for place, there in held.items():
                    for (a, x), (b, y) in itertools.product(options, there):
                        if a == b:
                            line = lines.setdefault(place - at, (set(), set()))
                            line[0].add(at)
                            line[1].update((p, q) for p, q in zip(x, y))
            covered, changed = set(), False
            for places, values in lines.values():
                apart = [q for p, q in values if p[0] != "number"]
                if len({p[1] if p[0] != "number" else "#" + p[1] for p, _ in values}) == len(values) and len({q[1] for q in apart}) == len(apart):
                    covered |= places
                    changed |= any(p != q for p, q in values)
            if len(covered) >= 0.8 * len(windows):
                want[j, i] = (len(covered) / len(windows), len(windows), changed)
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["share"], r["windows"], r["changed"]) for r in found.collect()}
    assert len(want) > 40 and got == want


def test_a_common_labelled_key_is_one_row(spark):
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 900 ELSE id END AS doc_id", "concat(IF(id % 3 = 0, 'good, plain text. ', 'BAD BAD! || '), id) AS text")
    labels = spark.range(901).selectExpr("id AS doc_id", "IF(id = 900, 1, id % 2) AS quality", "0 AS toxic").filter("doc_id % 3 > 0 or doc_id = 900")
    chosen = labels.selectExpr("doc_id AS id", "quality AS good")
    got = [r["text"] for r in labelled(docs, chosen.union(chosen.filter("id = 900")), "doc_id", "text").filter("id = 900").collect()]
    assert len(got) == 2 and got[0] == got[1] == min((f"good, plain text. {i}" for i in range(0, 900, 3)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    one = docs.filter("doc_id <> 900").union(spark.createDataFrame([(900, got[0])], docs.schema))
    assert train_ranking(docs, labels) == train_ranking(one, labels)


def test_pipeline(spark, sf_dir):
    docs = Q.table(spark, sf_dir, "documents")
    now = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        if name != "encoding":
            assert now.columns == docs.columns
            now = now.persist()
        sizes.append(now.count())
    assert sizes[0] < docs.count() and sizes == sorted(sizes, reverse=True) and now.filter("not same").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]


@pytest.mark.parametrize("n", [2, 4, 5, 19, 20])
def test_template_at_any_number_of_pages(spark, n):
    """Boxes with neutral names go, in the article and without one; text that varies stays, repeated headings in articles too."""
    boxes = "<div class='k'>Standing note of this site</div><div class='l'>Subscribe to our weekly letter now</div>"
    menu = "<div class='m'><a href='/a'>First shelf</a> <a href='/b'>Second shelf</a></div>"
    plain = f"<html><body>{menu}{boxes}<div class='c'><h1>Head {{0}}</h1><p>Para {{0}} alpha beta and more of it.</p><p>Para gamma {{0}}.</p></div>{{1}}</body></html>"
    marked = f"<html><body>{menu}<article><h2>News</h2>{boxes}<p>Para {{0}} alpha beta.</p><p>So long</p></article>{{1}}</body></html>"
    extra = "<div class='x'><p>Closed on Monday</p><p>Open again soon</p></div>"
    pages = [(2 * i + k, f"https://{h}.example/{i}", page.format(i, extra if i % 2 and n > 2 else "")) for k, (h, page) in enumerate({"p": plain, "a": marked}.items()) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(n):
        assert got[2 * i] == f"Head {i}\nPara {i} alpha beta and more of it.\nPara gamma {i}."
        assert got[2 * i + 1] == f"News\nPara {i} alpha beta.\nSo long"


def test_optional_box_in_the_slot(spark):
    """A class that is not on all pages nests in the main slot; a passage that two articles share does not."""
    box = "<div class='x'><h3>Read on</h3><p>Ten stories of the week</p></div>"
    page = "<html><body><div class='c'><p>Para {0} alpha.</p>{1}<p>Omega {0}.</p></div></body></html>"
    pages = [(i, f"https://o.example/{i}", page.format(i, box if i % 3 == 0 else "<p>One passage for two.</p>" if i in (1, 2) else "")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Para {i} alpha.\n" + ("One passage for two.\n" if i in (1, 2) else "") + f"Omega {i}." for i in range(12)}


def test_pages_that_do_not_vary_in_the_slot_stay(spark):
    page = "<html><body><div class='m'><a href='/{0}'>Shelf {0}</a></div><article><div class='b'><p>The same text</p></div></article></body></html>"
    pages = spark.createDataFrame([(i, "https://v.example/", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text(pages).collect()} == {"The same text"}


def plain_template(pages):
    """(slot, fixed) of a host by the definitions: vectors over the distinct pages, support with repeats."""
    often = collections.Counter(pages)
    pages = sorted(often)
    weigh = lambda v: sum(x * often[p] for x, p in zip(v, pages))
    under, tokens, texts = collections.defaultdict(lambda: [0] * len(pages)), {}, collections.defaultdict(lambda: [0] * len(pages))
    varying, dull = collections.Counter(), collections.Counter()
    for i, page in enumerate(pages):
        for path, furniture, opened, text, linked in blocks(page):
            around = ["/".join(path.split("/")[:k]) for k in range(2, path.count("/") + 2)]
            if opened:
                under[path][i] += 1
                dull[path] += often[page] * (furniture > 0)
            else:
                texts[path, text][i] += 1
                for p in around:
                    varying[p] += 0 if furniture else often[page] * max(0, len(text) - linked)
                    tokens.setdefault(p, []).append((path, text, 0 if furniture else often[page] * max(0, len(text) - linked)))
    ones = [1] * len(pages)
    skeleton = [p for p, v in under.items() if v == ones and 2 * dull[p] <= sum(often.values())]
    vary = {p: sum(c for path, text, c in tokens.get(p, ()) if texts[path, text] != ones) for p in skeleton}
    kind = lambda p: {"article": 2, "main": 1}.get(p.rsplit("/", 1)[1].split(".")[0], 0)
    best = max(vary.values())
    slot = max((p for p in skeleton if kind(p) or vary[p] >= 0.9 * best), key=lambda p: (kind(p), varying[p] if kind(p) else 0, p.count("/"), vary[p], p))
    main = lambda path: any(part.split(".")[0] in ("article", "main") for part in path.split("/"))
    fixed = set()
    if vary[slot]:
        for p, v in under.items():
            if max(v) == 1 and sum(v) >= 2 and weigh(v) >= 0.1 * sum(often.values()) and tokens.get(p) and all(texts[path, t] == v for path, t, _ in tokens[p]):
                if not (main(p.rsplit("/", 1)[0]) and p.rsplit("/", 1)[1].split(".")[0] in TEXT_ELEMENTS) and not f"{slot}/".startswith(f"{p}/"):
                    fixed.add(p)
        fixed |= {t for t, v in texts.items() if v == ones and not main(t[0])}
    return slot, fixed


@pytest.mark.parametrize("seed", range(3))
def test_templates_by_brute_force(spark, seed):
    """Pages of hosts put together from a few boxes, some of them optional, repeated or with varying words."""
    rng = random.Random(seed)
    pages = []
    for host in range(8):
        marked = rng.random() < 0.5
        boxes = [(rng.choice(["div", "div.a", "section.b", "p", "ul.c"]), rng.choice([1.0, 1.0, 0.5, 0.2]), rng.choice(["fixed", "fixed", "few", "own"]), rng.randrange(99)) for _ in range(7)]
        for i in range(rng.choice([2, 3, 7, 20])):
            body = []
            for name, often, words, n in boxes:
                if rng.random() < often:
                    tag, _, label = name.partition(".")
                    text = {"fixed": f"Box {n} of words", "few": f"Box {n} {rng.randrange(2)}", "own": f"Box {n} with text of page {i}"}[words]
                    body.append(f"<{tag} class='{label}'>" + (f"<p>{text}</p><p>end</p>" if tag != "p" and n % 2 else text) + f"</{tag}>")
            cut = rng.randrange(2, 5)
            inner = "".join(body[cut:])
            page = f"<html><body>{''.join(body[:cut])}{'<article>' if marked else '<div class=z>'}{inner}{'</article>' if marked else '</div>'}</body></html>"
            pages += [(f"h{host}", page)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame([(f"https://{h}.example/", p) for h, p in pages], "url string, html string").repartition(4)
    got = {r["host"]: (r["slot"], set(r["fixed"] or ())) for r in templates(df).collect()}
    hosts = {h: [p for g, p in pages if g == h] for h, _ in pages}
    want = {f"{h}.example": plain_template(p) for h, p in hosts.items() if len(set(p)) > 1}
    named = lambda fixed: {f if isinstance(f, str) else _digest(*f) for f in fixed}
    assert len(want) > 4 and {h: t for h, t in got.items() if h != "*"} == {h: (slot, named(fixed)) for h, (slot, fixed) in want.items()}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Scattered copies of one text, some near to few others: blocks lose no link."""
    rng = random.Random(11)
    base, texts = [f"w{k}" for k in range(90)], []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(90), rng.randint(0, 6)):
            w[k] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(words, texts)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) > 5
    docs = documents(spark, list(enumerate(texts)))
    for block in (1 << 20, 1500):
        monkeypatch.setattr("prismatica.llm.near_dedup.BLOCK", block)
        found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, width=3, percent=85).collect()}
        assert [found[i] for i in range(len(texts))] == label


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows beyond any one block count: the figures are those of all labelled texts."""
    import sys
    rank = sys.modules["prismatica.llm.quality_rank"]
    texts = [(i, f"plain words, number {i}." if i % 5 else f"$$$ {i} |||") for i in range(21_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, _ in texts], "doc_id long, quality int")
    model = train_ranking(docs, labels)
    x = np.array([rank.signals(t) for _, t in texts])
    assert np.allclose(model["middle"], x.mean(0)) and np.allclose(model["spread"], x.std(0) + 1e-6)
    score = np.clip((x - np.array(model["middle"])) / np.array(model["spread"]), -8, 8) @ np.array(model["weights"])
    assert model["threshold"] == pytest.approx(np.quantile(score, 0.2)) and (score[1] > model["threshold"]) and score[0] <= model["threshold"]
