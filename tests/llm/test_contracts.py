"""Pages and benchmark items that results once departed from the contract on."""

import re
from collections import defaultdict
from pathlib import Path

import pytest

from matchloom.llm import decontaminate, html_extract

DATA = Path("/root/testdata/sf0.001")
ARTICLE = "<article><h1>Title of it</h1><p>" + "Some words of the text. " * 12 + "</p><p>Short one.</p>%s</article>"
TALK = "<p>" + "I think that this is a very good text indeed. " * 9 + "</p>"


def text(body):
    return html_extract.main_text(f"<html><body>{body}</body></html>")


PLAIN = text(ARTICLE % "")


def test_plain_article():
    assert PLAIN.startswith("Title of it Some words") and PLAIN.endswith("Short one.")


@pytest.mark.parametrize("around", [
    '<div class="page with-sidebar">%s</div>', '<div class="has-comments">%s</div>', "<form>%s</form>", '<main><section id="search">%s</section></main>', '<div id="social"><div class="legal">%s</div></div>',
    '<div class="layout with-sidebar"><nav><a href="/">Home page</a></nav>%s<footer>Copyright by us</footer></div>',
])
def test_words_of_enclosing_elements_do_not_cost_the_article(around):
    assert text(around % (ARTICLE % "")) == PLAIN


def test_words_of_the_article_itself():
    assert text((ARTICLE % "").replace("<article>", '<article class="category-legal comments-open">')) == PLAIN
    assert text('<main><section id="search"><p>' + "Binary search halves the range. " * 8 + "</p></section></main>") == ("Binary search halves the range. " * 8).strip()
    assert text(ARTICLE % "" + f'<article class="comment">{TALK}</article>' * 9) == PLAIN


@pytest.mark.parametrize("inside", [
    '<div class="notice">' + "We use cookies to make this better. " * 6 + "</div>", '<div class="ad">' + "Buy this now and save much money. " * 6 + "</div>",
    '<div class="newsletter"><p>' + "Sign up for our letter. " * 9 + "</p></div>", f'<div class="comments">{TALK}</div>', f"<aside>{TALK}</aside>", "<form><label>Your name</label><p>" + "Write to us. " * 9 + "</p></form>",
])
def test_marked_parts_of_the_article_go_whatever_their_length(inside):
    assert text(ARTICLE % inside) == PLAIN


def test_unmarked_text_below_the_article_goes():
    assert text(ARTICLE % "" + f"<section><h2>Comments</h2>{TALK}</section>") == PLAIN


def test_pages_without_an_article_keep_their_text():
    assert text("<div><p>" + "No such element here. " * 9 + '</p></div><nav><a href="/x">Home</a></nav>') == ("No such element here. " * 9).strip()


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["page with-sidebar", "category-legal", "has-comments"])
def test_wrapped_pages_give_the_same_text(spark, name):
    pages = [r.html or "" for r in spark.read.parquet(str(DATA / "pages.parquet")).select("html").collect()]
    wrapped = [re.sub(r"(<body[^>]*>)(.*)(</body>)", rf'\1<div class="{name}">\2</div>\3', p, flags=re.S) for p in pages]
    assert sum(a != b for a, b in zip(pages, wrapped)) > len(pages) / 2
    assert [html_extract.main_text(p) for p in wrapped] == [html_extract.main_text(p) for p in pages]


# --- decontamination ------------------------------------------------------------------------


def found(spark, docs, items):
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b).collect()}


def test_tables_of_numbers_match_copies_only(spark):
    table = "table " + " ".join(map(str, range(300)))
    docs = [" ".join(str((7 * i + k) % 1000) for i in range(4000)) for k in range(4)]
    assert found(spark, docs, [table]) == {}
    got = found(spark, [*docs, "Look: " + table], [table])
    assert set(got) == {(4, 0)} and got[4, 0].coverage == 1.0


def test_questions_with_other_values_are_found(spark):
    item = "A train leaves the station at 40 km per hour and needs 3 hours to the next town. How far is it when it goes 40 km per hour?"
    other = item.replace("40", "75").replace("3 hours", "5 hours")
    torn = item.replace("40 km per hour?", "90 km per hour?")
    assert set(found(spark, [item, other, "Nothing like it at all in this text of a few words here."], [item])) == {(0, 0), (1, 0)}
    assert (0, 0) in found(spark, [torn], [item])


def tokens(t):
    """Template tokens of plain test texts: words without capitals, and numbers."""
    return [("#", w) if w.isdigit() else (w, None) for w in re.findall(r"[a-z0-9]+", t.lower())]


def plain_matches(doc, item, k=8):
    """Windows of the item that the document holds with consistent numbers, by comparing all pairs of windows."""
    d, i = tokens(doc), tokens(item)
    n = min(k, len(i))
    aligned = defaultdict(list)
    for x in range(len(d) - n + 1):
        for y in range(len(i) - n + 1):
            a, b = i[y : y + n], d[x : x + n]
            bare = sum(t[1] is None for t in a) < 2 or sum(t[1] is None for t in b) < 2
            if a == b or not bare and [t[0] for t in a] == [t[0] for t in b]:
                aligned[x - y].append((y, [(y + j, a[j][1], b[j][1]) for j in range(n) if a[j][1]]))
    matched = set()
    for windows in aligned.values():
        votes = defaultdict(lambda: defaultdict(set))
        for _, binding in windows:
            for at, a, b in binding:
                votes[a][b].add(at)
        good = {(a, b) for a, bs in votes.items() for b, ats in bs.items() if a == b or 2 * len(ats) > sum(map(len, bs.values()))}
        matched |= {y for y, binding in windows if all((a, b) in good for _, a, b in binding)}
    return len(matched), max(1, len(i) - n + 1)


def test_equals_comparing_all_windows(spark):
    import random

    rng = random.Random(11)
    word = lambda: rng.choice(["".join(rng.choices("bcdfg", k=4)), str(rng.randrange(10, 60))]) if rng.random() < 0.5 else "".join(rng.choices("bcdfg", k=5))
    items = [" ".join(word() for _ in range(rng.randint(9, 30))) for _ in range(12)]
    docs = []
    for _ in range(60):
        t = [word() for _ in range(rng.randint(0, 8))]
        for it in rng.sample(items, 2):
            w = it.split()
            a = rng.randrange(len(w) // 2)
            new = {x: str(rng.randrange(10, 60)) for x in w if x.isdigit()} if rng.random() < 0.5 else {}
            t += [new.get(x, x) if rng.random() < 0.95 else word() for x in w[a:]]
        docs.append(" ".join(t))
    want = {}
    for x, d in enumerate(docs):
        for y, i in enumerate(items):
            n, total = plain_matches(d, i)
            if n and (n / total >= 0.5 or n >= 13):
                want[x, y] = (n, total)
    got = {k: (r.matched, r.item_windows) for k, r in found(spark, docs, items).items()}
    assert len(want) > 40 and got == want
