import json
import random

from wardwatch.llm.wrappers import blocks_of, expression, extracted, folded, infer, main_text, merged

DDL = "page_id long, url string, html string, host string, slots int"


def page(paragraphs, links=2, comments=0, extra=""):
    nav = "".join(f'<li><a href="/{k}">l{k}</a></li>' for k in range(links))
    said = "".join(f'<div class="comment">said {k}</div>' for k in range(comments))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- <p>x</p> -->'
        f'<div class="ad">buy</div>{extra}<article><h1>Head &amp; line</h1>{body}{said}</article><footer>&copy; me</footer></body></html>'
    )


def wrapper_of(text):
    return folded(blocks_of(text)[0])


def test_repeats_and_options_are_inferred():
    one = wrapper_of("<div><p>a</p><p>b</p><p>c</p></div>")
    assert expression(one) == "<div>(<p>#</p>)+</div>"
    two = wrapper_of("<div><h2>x</h2><p>a</p></div>")
    assert expression(merged(one, two)) == "<div>(<h2>#</h2>)?(<p>#</p>)+</div>"
    three = wrapper_of("<div><p>a</p></div><table><tr><td>1</td></tr></table>")
    assert expression(merged(merged(one, two), three)) == "<div>(<h2>#</h2>)?(<p>#</p>)+</div>(<table><tr><td>#</td></tr></table>)?"


def test_article_only():
    text = main_text(page(["one  two\n three", "x&lt;y &eacute;"], comments=2), None)
    assert text == "Head & line\none two three\nx<y é"


def test_open_tags_and_inline_markup():
    html = "<body><article><h1>T</h1><p><b>first<br><p>sec<i>ond</i> <a href=x>link</a></p><aside>no</aside><form>f</form></article></body>"
    assert main_text(html, None) == "T\nfirst\nsecond link"
    assert main_text("<article><p>open", None) == "open"
    assert main_text('<article><p title="a>b">q</p><div class="cookie-notice"><p>n</p></div></article>', None) == "q"


def rows():
    found = []
    for k in range(40):
        found.append((k, f"http://a.example/{k}", page([f"text {k} {j}" for j in range(k % 5)], links=k % 4, comments=k % 3), "h", 1))
    for k in range(12):
        body = f'<div id="top"><a href="/">home</a> <a href="/b">b</a></div><div class="box"><div>Body text number {k} of the story.</div><div>More {k}.</div></div><div>Always the same line</div>'
        found.append((100 + k, f"https://B.example:80/{k}?q", f"<html><body>{body}</body></html>", "h", 1))
    found += [(200, None, None, "h", 1), (201, "nonsense", "", "h", 1), (None, "http://a.example/x", page(["t"]), "h", 1), (3, "http://a.example/3", page(["t"]), "h", 1)]
    found.append((202, "http://a.example/long", page(["word " * 50_000]), "h", 1))
    return found


def test_pages_and_hosts(spark):
    frame = spark.createDataFrame(rows(), DDL).repartition(5)
    got = {}
    for r in extracted(frame).collect():
        got.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    for k in range(40):
        want = "\n".join(["Head & line", *[f"text {k} {j}" for j in range(k % 5)]])
        assert want in [r["text"] for r in got[k]]
    for k in range(12):
        assert got[100 + k][0]["text"] == f"Body text number {k} of the story.\nMore {k}."
    assert got[200][0]["text"] == "" and got[200][0]["url"] is None and got[201][0]["text"] == ""
    assert got[None][0]["text"] == "Head & line\nt" and len(got[3]) == 2
    assert got[202][0]["n_chars"] == len("Head & line\n") + 5 * 50_000 - 1
    wrappers = {r["host"]: json.loads(r["wrapper"]) for r in infer(frame).collect()}
    assert wrappers["a.example"]["pages"] == 43 and wrappers["b.example:80"]["pages"] == 12
    assert "(<li>#</li>)+" in expression(wrappers["a.example"]["items"])


def test_empty(spark):
    assert extracted(spark.createDataFrame([], DDL)).collect() == []


def texts_of(spark, pages):
    frame = spark.createDataFrame([(k, f"http://{host}/{k}", text, "h", 1) for k, (host, text) in enumerate(pages)], DDL).repartition(3)
    return {r["page_id"]: r["text"] for r in extracted(frame).collect()}


def test_slots_of_the_expression_decide(spark):
    # The same tags enclose the line that never varies and the story: only the place in the expression tells them apart.
    pages = [("a", f"<body><h1>T{k}</h1><div>Same line on each page</div><hr><div>Story {k} {'is long ' * 9}</div></body>") for k in range(6)]
    assert texts_of(spark, pages) == {k: f"T{k}\nStory {k} {'is long ' * 9}".strip() for k in range(6)}


def test_long_pages_are_aligned():
    one = ["h2", "#", "/h2", "p", "#", "/p"] * 150
    two = ["table", "#", "/table", *one, "ul", "#", "/ul"]
    assert expression(merged(folded(one), folded(two))) == f"(<table>#</table>)?{'<h2>#</h2><p>#</p>' * 150}(<ul>#</ul>)?"
    x = [t for k in range(150) for t in (f"a.x{k}y", f"/a.x{k}y")]
    y = [t for k in range(150) for t in (f"b.x{k}y", f"/b.x{k}y")]
    both = expression(merged([*x, "p", "/p"], [*y, "p", "/p"]))
    assert both.endswith("<p></p>") and both.count("<p>") == 1


def test_templates_of_one_host(spark):
    plain = [("m", f"<body><div class='menu'>x</div><div class='box'><p>Story {k} of many.</p><p>More {k}.</p></div></body>") for k in range(5)]
    other = [("m", f"<body><table><tr><td>Cell {k}</td></tr></table></body>") for k in range(4)]
    pages = [*plain, *other, ("m", page(["text"]))]
    want = [*(f"Story {k} of many.\nMore {k}." for k in range(5)), *(f"Cell {k}" for k in range(4)), "Head & line\ntext"]
    assert texts_of(spark, pages) == dict(enumerate(want))


def test_copies_keep_their_text(spark):
    copy = "<body><div class='box'><h1>Title</h1><div>The only story.</div></div></body>"
    pages = [("c", copy)] * 5 + [("d", copy)] * 4 + [("d", copy.replace("only", "other"))] * 4
    got = texts_of(spark, pages)
    assert {got[k] for k in range(9)} == {"Title\nThe only story."}
    assert {got[k] for k in range(9, 13)} == {"Title\nThe other story."}


def test_deep_pages(spark):
    deep = [("e", "<div>" * 1500 + f"<p>Story {k}</p>" + ("<p>x</p>" if k else "<ul><li>1</li></ul>")) for k in range(2)]
    assert texts_of(spark, deep)[0].startswith("Story 0")


STORY = [f"<p>Paragraph {j} of a story, {'with words ' * 8}</p>" for j in range(4)]


def stories(k):
    return "".join(STORY).replace("story", f"story {k}"), "\n".join(f"Paragraph {j} of a story {k}, {'with words ' * 8}".strip() for j in range(4))


def test_names_around_the_story_do_not_silence_it(spark):
    layouts = [
        "<article class='post has-sidebar'>%s</article>",
        "<div class='content with-sidebar'><article>%s</article></div>",
        "<div class='nav-open'><main>%s</main></div>",
        "<div class='banner'><main>%s</main></div>",
        "<div class='sidebar'><div class='story'>%s</div></div>",
    ]
    pages, want = [], {}
    for n, layout in enumerate(layouts):
        for k in range(4):
            body, text = stories(k)
            want[len(pages)] = text
            pages.append((f"h{n}", f"<body><nav><a href='/'>home</a></nav>{layout % body}<footer>Foot</footer></body>"))
    assert texts_of(spark, pages) == want


def test_names_that_only_look_like_furniture(spark):
    body = "<article><h1>T</h1><p class='ad-free'>One %d</p><h2 id='comments-on-the-law'>Law</h2><p>Two %d</p><div class='comment-list'>reader %d</div><p class='ad'>buy %d</p></article>"
    pages = [("n", body.replace("%d", str(k))) for k in range(4)]
    assert texts_of(spark, pages) == {k: f"T\nOne {k}\nLaw\nTwo {k}" for k in range(4)}


def test_a_teaser_loses_to_the_story_beside_it(spark):
    pages = [("t", f"<body><article class='teaser'>Read {k}</article><div class='box'>{stories(k)[0]}</div></body>") for k in range(12)]
    assert texts_of(spark, pages) == {k: stories(k)[1] for k in range(12)}


def planted(seed=0):
    """Pages of hosts with templates of their own and a known main text."""
    r = random.Random(seed)
    pages, want = [], {}
    for host in range(8):
        frame = r.choice(["<article>%s</article>", "<main>%s</main>", "<div id='content'><div class='text'>%s</div></div>", "<section class='story'>%s</section>"])
        menu = "".join(f"<li><a href='/{j}'>Menu {host} {j}</a></li>" for j in range(r.randint(2, 6)))
        notice = f"<div>All rights of host {host} are reserved, see our terms.</div>"
        for k in range(12):
            blocks = [f"{r.choice('ABCDE')}{r.randrange(10**6)} text of page {k} {'and more of it ' * r.randint(3, 9)}".strip() for _ in range(r.randint(3, 7))]
            body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + (notice if host % 2 else "")
            aside = f"<div class='related-posts'><p>Other {r.randrange(99)}</p></div>" if r.random() < 0.5 else ""
            want[len(pages)] = "\n".join(blocks)
            pages.append((f"p{host}", f"<html><body><ul>{menu}</ul>{aside}{frame % body}<div>About host {host}</div></body></html>"))
    return pages, want


def test_planted_templates_and_what_inference_adds(spark, monkeypatch):
    pages, want = planted()
    got = texts_of(spark, pages)
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), got[wrong[0]], want[wrong[0]])
    # Without slots, pages lose their text or keep the notice.
    bare = {k: main_text(text, None) for k, (_, text) in enumerate(pages)}
    assert sum(bare[k] != want[k] for k in want) > len(want) / 3
