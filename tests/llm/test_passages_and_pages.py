"""Benchmark passages against edit distances; pages against what was put on them; the pipeline stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

from pricetide.llm import decontamination, style_tree

DOCS = "doc_id long, text string, item_id string, matches string"
BENCH = "item_id long, text string, extra string"


def distance(item, text):
    """Fewest edits between `item` and any part of `text`."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(out)


def test_passages_equal_edit_distances():
    rng, letters = random.Random(9), "abcdef gh"
    for _ in range(150):
        items = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for k in range(3)]
        noise = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        text = noise() + edited(rng, items[0][1], rng.randint(0, 8), letters).upper() + noise()
        best = {}
        for ident, start, end, edits in decontamination.Passages(items).matches(text):
            assert distance(items[ident][1], text[start:end].lower()) <= edits and 0 <= start <= end <= len(text)
            best[ident] = min(best.get(ident, 99), edits)
        for ident, item in items:
            d = distance(item, text.lower())
            assert (best.get(ident) == d) if d <= decontamination.budget(len(item)) else ident not in best


@pytest.mark.parametrize("letters", ["ab", "_", "_ ", "-x"])
def test_repetitive_passages(letters, monkeypatch):
    """Few letters make hot grams, counted by ranges, and long texts are searched in parts; results stay those of edits."""
    rng = random.Random(len(letters))
    for listed, part in ((0, 100), (50, 2**18), (2**17, 64)):
        monkeypatch.setattr(decontamination, "LISTED", listed)
        monkeypatch.setattr(decontamination, "PART", part)
        for _ in range(12):
            draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
            items = [(k, draw(rng.randint(5, 70))) for k in range(2)]
            text = draw(rng.randint(0, 150)) + edited(rng, items[0][1], rng.randint(0, 5), letters + "q") + draw(rng.randint(0, 150))
            found = decontamination.Passages(items).matches(text)
            best = {}
            for ident, start, end, edits in found:
                assert distance(items[ident][1], text[start:end]) <= edits
                best[ident] = min(best.get(ident, 99), edits)
                assert all(b <= start or end <= a for i, a, b, _ in found if i == ident and (a, b) != (start, end))
            for ident, item in items:
                d = distance(item, text)
                assert (best.get(ident) == d) if d <= decontamination.budget(len(item)) else ident not in best


def test_runs_of_one_character_take_linear_time_and_memory():
    import time
    import tracemalloc

    passage = "Name: " + "_" * 60 + " Date of the examination: " + "_" * 60
    passages = decontamination.Passages([(1, passage), (2, "." * 60 + " see the page of contents " + "." * 30)])
    for text, want in (("_" * 200_000, 0), (("_" * 70 + " ") * 3000, 0), ("." * 100_000 + passage + "_" * 100_000, 1), ("=-" * 100_000, 0)):
        start = time.perf_counter()
        assert len(passages.matches(text)) == want
        assert time.perf_counter() - start < 5  # a second on an idle machine
    tracemalloc.start()
    passages.matches("_" * 200_000)
    assert tracemalloc.get_traced_memory()[1] < 200e6


def test_passages_longer_than_a_million_characters():
    rng = random.Random(1)
    item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_100_000))
    text = "before " + item[:550_000] + "edit" + item[550_000:] + " behind"
    passages = decontamination.Passages([(1, item[:400] + item[-400:]), (2, "edit" + item[550_000:550_100])])
    assert [m[0] for m in passages.matches(text)] == [2]
    zero = decontamination.Passages([(3, item)])
    zero.edits[:], zero.least[:] = 4, decontamination.Q  # a narrow band, or the alignment would take minutes
    monkey = zero.regions(decontamination.plain(text, zero.case))
    assert monkey and all(low <= 7 < low + width + 5 for _, low, width in monkey)


def test_passages_in_tables(spark, frame, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARACTERS", 30)
    bench = [(1, "the quick brown fox jumps over it", "x"), (2, "another passage of the benchmark", None), (3, None, ""), (None, "no id at all here", ""), (4, "short", "")]
    rows = [
        (1, "so The Quick\nbrown fox jumps over it.", "a", "b"), (2, None, "", ""), (3, "", None, ""), (None, "x another passage of the benchmark", "", None),
        (4, "clean text", "", ""), (5, "the quick brawn fox jumps ovr it" + " filler" * 20000, "", ""), (1, "so The Quick\nbrown fox jumps over it.", "a", "b"),
    ]
    docs, items = frame(rows, DOCS), frame(bench, BENCH)
    found = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in decontamination.contaminated(docs, items).collect())
    assert found == [("1", 1, 3, 36, 0), ("1", 1, 3, 36, 0), ("5", 1, 0, 32, 2), ("None", 2, 2, 34, 0)]
    kept = decontamination.clean(docs, items)
    clash = docs.withColumnRenamed("matches", "found")
    assert decontamination.clean(clash, items).columns == clash.columns
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4"]
    assert decontamination.clean(docs, items.filter("false")).count() == len(rows)
    assert decontamination.contaminated(docs.filter("false"), items).collect() == []


def page(body, tail="</body></html>"):
    return f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>{body}{tail}'


def test_reading_of_markup():
    text = lambda source: style_tree.main_text(source, set())
    assert text(page("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four &#233;&nbsp;&lt;x&gt;</article><footer>f</footer>")) == "A & B one two three four é <x>"
    assert text(page('<article><p title="a > b">x</p><!-- <p>no</p> --><div class="comments"><p>me too</p></div></article><aside>s</aside>')) == "x"
    assert text(page('<div class="cookie-notice">c</div><header>h</header><main><header><h1>t</h1></header>b</main><form>f</form>')) == "t b"
    assert text("") == "" and text("no markup") == "no markup" and text("a < b <p>c <i") == "a < b c"
    assert text(page("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>", "")) == "a b c d e"
    assert text("<div>" * 30000 + "deep") == "deep"


def test_names_do_not_take_the_article():
    text = lambda source: style_tree.main_text(page(source), set())
    for attribute in ('style="overflow:hidden"', 'title="the hidden cost"', 'data-id="ad-12"', "data-role='navigation'", 'aria-label="hidden"', 'data-x=hidden', 'data-class="ads" class=text'):
        assert text(f"<div {attribute}><p>kept</p></div>") == "kept"
    for attribute in ('hidden', 'HIDDEN=""', 'a="b"hidden', 'class="x" id=ad-12', "role='navigation'", 'aria-hidden = "true"', "class=ads class=text"):
        assert text(f"<p>long enough text</p><div {attribute}><p>gone</p></div>") == "long enough text"
    for wrapper in ('div class="has-sidebar"', 'div id="content-with-comments"', "form", 'div role="form"'):
        tag, inner = wrapper.split()[0], '<div class="sidebar"><p>other things, longer than the article</p></div>'
        assert text(f"<{wrapper}>{inner}<article class='post has-comments'><p>kept</p><div class='comments'><p>no</p></div></article></{tag}>") == "kept"
        assert text(f"<{wrapper}><p>most of the text of this page is here</p><div class='comments'><p>no</p></div></{tag}><p>and</p>") == "most of the text of this page is here and"
        assert text(f"<nav><{wrapper}><article>no</article></{tag}></nav><p>kept</p>") == "kept"
    assert text("<article><p>x</p></article><div class='comments'><article class='comment'><p>longer than the article</p></article></div>") == "x"
    assert text("<div class='ads'>" * 30000 + "deep") == "deep"


def test_names_inside_an_article_are_places_of_its_text():
    text = lambda source: style_tree.main_text(page(source), set())
    sections = '<section id="ad"><p>in the year</p></section><section id="notice-periods"><p>of the law</p></section><div class="social-history"><p>of towns</p></div>'
    gone = '<div class="comments-area"><p>no</p></div><div class="ad"><p>no</p></div><div class="share-buttons">no</div><div id="comments"><p>no</p></div>'
    assert text(f"<article><p>first</p>{sections}{gone}</article>") == "first in the year of the law of towns"
    assert text(f'<div id="notice">no</div><main>{sections}{gone}</main>') == "in the year of the law of towns"


def test_quotes_open_values_only_behind_an_equals_sign():
    text = lambda source: style_tree.main_text(page(source), set())
    assert text("<article><p title=it's>Body one isn't dropped.</p><p>It's two.</p></article>") == "Body one isn't dropped. It's two."
    assert text("""<article><p data-x='a > b' title = "c > d" it's>one</p><p "odd">two</p><p title=">three</p></article>""") == "one two three"
    assert text('<article><p class=x" id=y\'>one</p><p>two "three" \'four</p></article>') == "one two \"three\" 'four"


def test_unnamed_boilerplate_goes_by_its_importance(frame):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(300):
        body = words(rng.randint(20, 60))
        want[i] = f"{body} & more"
        box = ["Subscribe now and never miss a thing", "Our terms have changed, read them"][i % 2]
        rows.append((i, f"http://h{i % 2}.example/{i}", page(f"<div><p>{box}</p></div><section><p>{body} &amp;\n more</p></section>"), 1, "z"))
    rows += [(1000, None, None, None, None), (1001, "odd", "", 1, ""), (rows[0])]
    pages = frame(rows, "page_id long, url string, html string, host int, text string")
    out = style_tree.extract(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == want.get(r.page_id, "") and r.n_chars == len(r.text)
    assert style_tree.extract(pages.filter("false")).collect() == []


@pytest.mark.parametrize("n", [350, 35000])
def test_copies_of_a_page_are_no_template(spark, n):
    """Four of seven pages of a host are copies of one; every page keeps its paragraphs at either size."""
    article = F.when(F.col("id") % 7 < 4, F.lit("0000000")).otherwise(F.lpad(F.col("id").cast("string"), 7, "0"))
    text = lambda host: F.concat_ws(" ", *[F.concat(F.lit(f"{host}w{k}x"), article) for k in range(8)])
    made = lambda host, rows: rows.select(
        F.col("id").alias("page_id"), F.lit(f"http://{host}.example/x").alias("url"), text(host).alias("want"),
        F.concat(F.lit("<body><div>the menu of all pages</div><article><p>"), text(host), F.lit("</p></article></body>")).alias("html"))
    pages = made("a", spark.range(n)).unionByName(made("b", spark.range(n, n + 300).withColumn("id", F.col("id") * 7 + 5)))
    pages = pages.unionByName(made("c", spark.range(0, 2100, 7)))
    out = style_tree.extract(pages.drop("want")).select("page_id", "url", "text")
    assert out.count() == n + 600
    joined = out.join(pages.select("page_id", "url", "want"), ["page_id", "url"])
    assert joined.filter(~F.col("text").endswith(F.col("want"))).count() == 0
    assert joined.filter("url like '%a.example%' and text <> want").count() == 0


def test_given_pages_keep_their_articles(spark):
    import html
    import re

    from pricetide.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in QUERIES["op9_site_style_tree"](spark, folder).collect():
        article = re.sub("</?b>", "", re.search("<article>(.*)</article>", source[r.page_id], re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_pipeline_stages(spark):
    import corpus_pipeline
    from pricetide.llm import minhash, toxicity
    from pricetide.llm.common import stored, table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    bench = [r.text.lower() for r in table(spark, folder, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(before)
            break
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == corpus_pipeline.COLUMNS and set(after) <= set(before)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
            gone = set(before) - set(after)
            assert sum(labels[d] == 1 for d in gone if d in labels) >= 0.8 * sum(labels.get(d) == 1 for d in before)
            assert all(after[d] == before[d] for d in after)
        elif name == "line_dedup":
            seen = set()
            for d in sorted(after):
                for line in after[d].split("\n"):
                    if len(line.split()) >= 50:
                        assert line.strip() not in seen
                        seen.add(line.strip())
        elif name == "near_dedup":
            sets = {d: set(minhash.shingle_set(t).tolist()) for d, t in before.items()}
            links = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])}
            assert set(before) - set(after) == {b for _, b in links}
        else:
            held = {d for d, t in before.items() if any(b in t.lower() for b in bench)}
            assert set(before) - set(after) == held
        before = after
    assert toxicity.WINDOW > toxicity.STRIDE


def test_near_copies_of_80_percent_go_in_the_pipeline(spark, frame):
    """Near copies around the threshold, by brute force; the stages behind get what is left."""
    import corpus_pipeline
    from pricetide.llm import minhash
    from pricetide.llm.common import stored, table

    folder = "/root/testdata/sf0.001"
    rng = random.Random(80)
    rows = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(104)]
        rows.append((2 * group, " ".join(base), "en", "s", 1))
        cut = 70 + group // 2  # this many shingles of a hundred, from one side
        rows.append((2 * group + 1, " ".join(base[: cut + 4] if rng.random() < 0.5 else base[-cut - 4 :]), "en", "s", 1))
    given = table(spark, folder, "documents").select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars").toDF(*corpus_pipeline.COLUMNS)
    docs = stored(frame(rows, given.schema).unionByName(given))
    before = {r.doc_id: r.text for r in docs.collect()}
    sets = {d: set(minhash.shingle_set(t).tolist()) for d, t in before.items()}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    names = sorted(sets)
    for i, b in enumerate(names):
        for a in names[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    want = {d for d in sets if find(d) != d}
    assert {2 * g + 1 for g in range(40)} & want == {2 * g + 1 for g in range(20, 40)}
    stages = dict(corpus_pipeline.STAGES)
    docs = stored(stages["near_dedup"](spark, docs, folder))
    after = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == corpus_pipeline.COLUMNS and set(before) - set(after) == want
    bench = [r.text.lower() for r in table(spark, folder, "benchmark").collect()]
    docs = stored(stages["decontamination"](spark, docs, folder))
    clean = {r.doc_id for r in docs.collect()}
    assert set(after) - clean == {d for d, t in after.items() if any(b in t.lower() for b in bench)}
    assert {r.doc_id for r in stages["packing"](spark, docs, folder).collect()} == clean


@pytest.mark.parametrize("length", [16, 17, 50, 200, 5000])
def test_budget_leaves_a_gram(length):
    assert decontamination.least_shared(length) >= 1
