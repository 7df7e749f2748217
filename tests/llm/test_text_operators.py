import random
import re
import time
from html import escape
from itertools import combinations

from lodestone.llm.html_lines import SURGE, extracted, lines_of, main_text, passages
from lodestone.llm.html_lines import WINDOW as WINDOW_LINES
from lodestone.llm import spaced_seeds
from lodestone.llm.spaced_seeds import PERCENT, WINDOW, contaminated, decontaminated

PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><div id="page"><header class="site-header"><h1>Site</h1></header>
<div class="navbar">Home | About</div><div class="cookie-notice">We use cookies to do this and that.</div>
<div class="content"><h2>Title &lt;x&gt; here</h2><div class="post-body"><p>First paragraph of the article with a <a href="#">link</a> in it.<p>Second&nbsp;one
   &#233;.<div class="advertisement">Buy this thing now</div><p>Third. <br>After break<ul><li>item one<li>item two</ul><blockquote>Quote it</blockquote></div></div>
<div class="sidebar"><p>Other stories you may like a lot and should read now</p></div><form><p>Your name</p></form>
<section id="comments"><p>Reader: great article, I liked it very much indeed.</p></section><footer>&copy; 2020</footer></div></body></html>"""
TEXT = "Title <x> here\nFirst paragraph of the article with a link in it.\nSecond one é.\nThird.\nAfter break\nitem one\nitem two\nQuote it"


def test_page_without_article_element():
    assert main_text(PAGE) == TEXT


def test_article_keeps_all_its_blocks():
    page = "<body><nav><a href=x>Menu</a></nav><div class='wrapper ad'>" + "<article><header><h1>Head</h1></header><p>One.</p><aside>side</aside><p>T&amp;wo</p><div class=share-buttons>Share</div><p>3" + "</article></div><footer>f</footer>"
    assert main_text(page) == "Head\nOne.\nT&wo\n3"


def test_comments_and_teasers_in_article_elements():
    page = "<body><main><div class=sidebar><article><h3>Other</h3><p>short</p></article></div><article class=post><p>The text of the page, long enough to be longer than twice a teaser.</p><p>End</p></article><div id=comments><article class=comment><p>I liked it and I say so at length here.</p></article></div><section class=related-posts><article class=teaser><p>More</p></article></section></main>"
    assert main_text(page) == "The text of the page, long enough to be longer than twice a teaser.\nEnd"
    teasers = "<body><div class=story>" + "<p>A paragraph of the real text that goes on.</p>" * 5 + "</div><div><article><p>tiny</p></article></div>"
    assert main_text(teasers).startswith("\n".join(["A paragraph of the real text that goes on."] * 5))


def test_closing_paragraph_after_an_advert():
    first = "".join(f"<p>Paragraph {i} of a long first part.</p>" for i in range(50))
    page = f"<body><nav><a href=x>Menu</a></nav><div class=post>{first}<aside>Buy</aside><p>The end.</p></div><footer>f</footer>"
    assert main_text(page).endswith("Paragraph 49 of a long first part.\nThe end.")


def test_wrappers_of_the_whole_page_are_kept():
    text = "<p>The first paragraph of the page.</p><div class=advert>Buy</div><p>The second one.</p>"
    want = "The first paragraph of the page.\nThe second one."
    for begin, end in (("<form action=x>", "</form>"), ("<div class='no-sidebar'>", "</div>"), ("<form id=f><div class='no-sidebar'>", "</div></form>")):
        assert main_text(f"<body><nav><a href=x>Menu of the site</a></nav>{begin}{text}{end}<footer>f</footer></body>") == want
    assert main_text(f"<body><div hidden>{text}</div><form><p>Your name</p></form></body>") == ""
    assert main_text(f"<body><article>{text}<section id=discussion><p>We discuss.</p></section></article>") == want + "\nWe discuss."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<div>") == main_text("<!-- never closed") == ""
    assert main_text("<p>a &am") == "a &am"
    assert main_text("<p>text<br") == "text"
    assert main_text("plain & simple") == "plain & simple"
    assert main_text("<article><p>broken off <b>here") == "broken off here"
    long = "<article>" + "".join(f"<p>Paragraph {i} with some words.</p>" for i in range(5000)) + "</article>"
    assert main_text(long).count("\n") == 4999


def test_surges_and_dives():
    lines = [len(t) for t in ["men", "", "", "", "a" * 60, "", "b" * 9, "", "", "", "", "fo"]]
    assert passages(lines) == [(4, 7)] and passages(lines[:4]) == [(0, 1)] and passages([]) == passages([0, 0]) == []
    assert [t for t, _, _ in lines_of("<p>a<b>b</b></p> c <nav>x</nav><aside>y</aside>d")] == ["ab", "c", "", "d"]


def test_passages_match_brute_force():
    """Every window summed by itself: lines under a window with weight belong together if such windows touch."""
    rng = random.Random(3)
    for _ in range(400):
        w = [rng.choice([0, 0, 0, 0, 1, 2, 30, 100]) for _ in range(rng.randint(0, 40))]
        sums = {i: sum(w[max(i, 0) : i + WINDOW_LINES]) for i in range(-WINDOW_LINES + 1, len(w))}
        most, want, i = max(sums.values(), default=0), [], -WINDOW_LINES + 1
        while i < len(w):
            j = i
            while sums.get(j, 0):
                j += 1
            if j > i:
                inside = [k for k in range(max(i, 0), min(j + WINDOW_LINES - 1, len(w))) if w[k]]
                if max(sums[k] for k in range(i, j)) >= SURGE * most:
                    want.append((inside[0], inside[-1] + 1))
            i = j + 1
        assert passages(w) == want, w


def test_the_distribution_decides_without_articles():
    text = "".join(f"<p>{'The story goes on and on in this paragraph. ' * 6}</p>" for _ in range(5))
    links = "".join(f"<li><a href=/{i}>Some linked headline</a></li>" for i in range(6))
    page = f"<body><div>Mini site</div><ul>{links}</ul><div><h1>The title</h1>{text}<p>Last words.</p></div><ul>{links}</ul><div>Imprint</div></body>"
    got = main_text(page)
    assert got.startswith("The title\nThe story") and got.endswith("\nLast words.")
    tiny = "<body><div>Mini site</div><main><p>Short.</p></main><div>Imprint</div></body>"
    assert main_text(tiny) == "Short."


def test_large_and_deep_pages_take_linear_time():
    for page in ("<div class=nav>x" * 30_000, "<article><p>x" * 30_000, "<div class=nav>" * 30_000 + "<article>x</article>", "<article>x</article>" * 30_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 5


def test_random_articles_round_trip(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        paragraphs = ["".join(rng.choices("ab cé&<>\"' .", k=rng.randint(1, 80))) for _ in range(rng.randint(1, 12))]
        clean = [re.sub(r"\s+", " ", p).strip() for p in paragraphs]
        want[i] = "\n".join(p for p in clean if p)
        rows.append((i, f"u{i}", f"<body><ul class=menu><li>m</ul><article>{''.join(f'<p>{escape(p)}</p>' for p in paragraphs)}</article><div class=footer>f</div>", "x"))
    rows += [(100, None, None, "x"), (None, "u", "", "x"), rows[0]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extracted(frame).collect()
    assert len(got) == 63
    assert all(r.text == want.get(r.page_id, "") and r.n_chars == len(r.text) for r in got)
    assert extracted(frame.limit(0)).count() == 0


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    """The definition, pair by pair and diagonal by diagonal."""
    out = set()
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, passage in items:
            t, best = tokens(passage), None
            if not t:
                continue
            for shift in range(-len(t) + 1, len(d)):
                same = [0 <= i + shift < len(d) and d[i + shift] == t[i] for i in range(len(t))]
                w = min(WINDOW, len(t))
                window = max((sum(same[j : j + w]) for j in range(len(t) - w + 1)), default=0)
                if window * 100 >= w * PERCENT:
                    best = max(best or (0, 0, 0, 0), (sum(same), -max(shift, 0), window, len(t)))
            if best:
                out.add((doc_id, item_id, -best[1], best[3], best[0], best[2]))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "a", "é"] * 6 + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(prose(rng.randint(9, 40)))) for i in range(8)] + [(20, None), (21, "too short"), (None, " ".join(prose(20)))]
    docs = []
    for i in range(60):
        words = prose(rng.randint(0, 80))
        if i % 2:
            passage = (rng.choice(items[:8])[1]).split()
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = rng.choice(["Zzz,", "yyy!"])
            cut = rng.randint(0, 6)
            words[rng.randint(0, len(words)) :] = [w.title() + rng.choice(["", ",", ".\n"]) for w in passage[cut:]]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[10][1]), docs[1]]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, shift int")
    bench = spark.createDataFrame([(*i, "x") for i in items + items[:2]], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in contaminated(frame, bench).drop("text_hash").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 15
    clean = decontaminated(frame, bench)
    assert clean.columns == frame.columns
    bad = {g[0] for g in got}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d[0] for d in docs if d[0] not in bad), key=str)
    assert contaminated(frame.limit(0), bench).count() == contaminated(frame, bench.limit(0)).count() == 0


def test_passages_in_scripts_without_spaces(spark):
    item = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。"
    changed = item.replace("猫", "犬").replace("見", "味")
    thai = "ประเทศไทยมีชื่ออย่างเป็นทางการว่าราชอาณาจักรไทย"
    docs = [(1, "前置きの文章" + item + "後に続く文"), (2, "これは" + changed + "です"), (3, "全く別の内容を持つ文章である。" * 9), (4, "Prose, " + item[:14] + " and more prose"), (5, "คำนำ" + thai + "ต่อ"), (6, "ラーメン"), (7, None), (8, "x" + item[:6] + "y")]
    items = [(10, item), (11, thai), (12, "ラーメン")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) == {(1, 10), (2, 10), (4, 10), (5, 11), (6, 12)}
    assert found[1, 10].matched == found[1, 10].item_tokens == sum(c.isalpha() for c in item) and found[1, 10].doc_start == 6
    assert found[2, 10].matched == found[1, 10].matched - 2 and found[4, 10].best_window == WINDOW


def test_masks_meet_every_accepted_passage(spark):
    for size in range(1, WINDOW + 1):
        for changed in combinations(range(size), size * (100 - PERCENT) // 100):
            assert any(all(s + k not in changed for k, c in enumerate(m) if c == "1") for m in spaced_seeds.masks_of(size) for s in range(size - len(m) + 1)), (size, changed)
    items = [(size, " ".join(f"w{size}x{i}" for i in range(size))) for size in range(1, 16)]
    docs = []
    for size, text in items:
        for n, changed in enumerate(combinations(range(size), min(size, WINDOW) * (100 - PERCENT) // 100)):
            docs.append((1000 * size + n, "before " + " ".join("zzz" if i in changed else w for i, w in enumerate(text.split())) + " after"))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, d // 1000) for d, _ in docs}


def test_names_of_article_text_do_not_drop_it():
    from lodestone.llm.html_lines import main_text

    filler = "".join(f"<p>Paragraph number {i} of the article says something of fair length.</p>" for i in range(6))
    kept = ['<h2 id="search">A heading</h2>', '<h2 id="sharing">A heading</h2>', '<h3 id="comments">A heading</h3>', '<h2 id="promotion">A heading</h2>', '<ul><li id="menu">A heading</li></ul>',
            '<section class="related-work"><p>A heading</p></section>', '<section class="commentary"><p>A heading</p></section>', '<div class="share-price"><p>A heading</p></div>', '<p class="notice">A heading</p>', '<p class="sponsorship-history">A heading</p>', '<div class="entry-header"><h1>A heading</h1></div>']
    for part in kept:
        assert "A heading" in main_text(f"<body><nav><a href=/>Home</a></nav><article>{filler}{part}{filler}</article></body>"), part
    assert "A heading" in main_text(f'<body><div class="entry-header"><h1>A heading</h1></div><div>{filler}</div></body>')
    for part in ('<div class="share-buttons">Share it</div>', '<section class="comments">Share it</section>', '<div id="related-posts">Share it</div>', '<div class="ad">Share it</div>', '<ul class="social-links"><li>Share it</ul>', '<div class="comments-area">Share it</div>', '<div class="page-footer">Share it</div>', '<aside>Share it</aside>', '<ins class="adsbygoogle">Share it</ins>', '<div class="cookie-banner">Share it</div>'):
        assert "Share it" not in main_text(f"<body><article>{filler}{part}{filler}</article></body>"), part
