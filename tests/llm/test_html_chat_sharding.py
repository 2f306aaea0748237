"""HTML extraction, preference formatting and sharding on hand-made rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

from llm.chat import preference_format, stale_reply_pairs
from llm.html_text import Page, StyleTree, extract_text, features, low_nodes
from llm.sharding import Sharding, assigned, fill


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def page(n, extra=""):
    return (
        f"<html><head><title>t{n}</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav>"
        f"<div class=top>Same banner</div><div class=box><p>Unique &amp; own text {n}<br>more\n  here<p>Second of {n}<b>!</b></div>"
        f"<div class=foot>Same imprint</div>{extra}<form><input value=1>send</form><script>if(a<b)'</p>'</script></body></html>"
    )


def test_boilerplate_of_a_host_goes(spark):
    rows = [(n, f"http://a.example/{n}", page(n)) for n in range(20)]
    rows += [(100, "http://b.example/1", page(100, "<!-- x --><div id=comments>I liked it</div><aside>side</aside>"))]
    rows += [(101, None, None), (102, "nonsense", ""), (None, "http://a.example/5", page(5)), (103, "http://a.example/z", "plain <")]
    got = {r["page_id"]: r["text"] for r in extract_text(pages_of(spark, rows)).collect()}
    for n in (*range(20), 100):
        assert got[n] == f"Unique & own text {n} more here\nSecond of {n}!"
    assert got[101] == got[102] == "" and got[None] == got[5] and got[103] == "plain <"
    assert extract_text(pages_of(spark, [])).count() == 0


def test_copies_of_a_page_are_one_page(spark, monkeypatch):
    story = "<div class=story><p>One article<p>told once</div>"
    rows = [(n, f"http://c.example/?v={n}", story) for n in range(12)]
    rows += [(20 + n, f"http://m{n}.example/", story.replace("story", "mirror")) for n in range(3)]
    rows += [(40 + n, f"http://a.example/{n}", page(n)) for n in range(20)]
    for limit in (1_000_000, 0):
        monkeypatch.setattr("llm.html_text.BROADCAST_ROWS", limit)
        got = {r["page_id"]: r["text"] for r in extract_text(pages_of(spark, rows)).collect()}
        assert {got[n] for n in (*range(12), 20, 21, 22)} == {"One article\ntold once"}
        assert got[43] == "Unique & own text 3 more here\nSecond of 3!"


def varied_pages(hosts=3, each=24):
    """Menus, adverts and footers that differ in some words from page to page, around unlike articles."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    links, slogans = [word(5) for _ in range(9)], [" ".join(word(4) for _ in range(6)) for _ in range(4)]
    rows, wanted = [], {}
    for n in range(hosts * each):
        title = f"{word(7)} {word(6)}"
        told = [" ".join(word(6) for _ in range(draw.randint(5, 40))) + "." for _ in range(draw.randint(1, 5))]
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in draw.sample(links, draw.randint(4, 6)))
        host = f"h{n % hosts}.example"
        html = (
            f"<div class=up><h2>Go to</h2><ul>{menu}</ul></div><div class=spot>{draw.choice(slogans)}</div><div class=text>"
            f"<h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in told)}<h2>Sources</h2><p>{word(8)}</div><div class=down>&copy; {host} {2000 + n}, {draw.choice(slogans)}</div>"
        )
        rows.append((n, f"http://{host}/{n}", html))
        wanted[n] = [title, *told]
    return rows, wanted


def test_the_tree_alone_removes_what_differs_in_some_words(spark, monkeypatch):
    rows, wanted = varied_pages()
    for roles, limit in ((True, 1000), (False, 1000), (False, 0)):
        monkeypatch.setattr("llm.html_text.HOST_NODES", limit)
        got = {r["page_id"]: r["text"] for r in extract_text(pages_of(spark, rows), StyleTree(roles=roles)).collect()}
        for n, told in wanted.items():
            lines = got[n].split("\n")
            assert lines[: len(told)] == told and lines[len(told)] == "Sources" and len(lines) == len(told) + 2


def plain_low(rows, settings):
    """Nodes of low importance, by the definition."""
    sites = defaultdict(lambda: defaultdict(list))  # host (None: all) -> node -> (features, child sequence) a page
    for host, html in {(host, html) for host, html in rows}:
        page, found = Page(html), defaultdict(lambda: [set(), None])
        for text, path, _ in page.blocks:
            node = path[-1] if path else 0
            found[node][0].update(features(text, settings.short))
            found[node][1] = page.children.get(path[-2] if len(path) > 1 else 0, 0)
        for node, fact in found.items():
            sites[host][node].append(fact)
    for html in {html for _, html in rows}:
        host = next(h for h, x in rows if x == html)
        page = Page(html)
        for node in {path[-1] if path else 0 for _, path, _ in page.blocks}:
            fact = next(f for f in sites[host][node] if f[0] >= {
                x for t, p, _ in page.blocks if (p[-1] if p else 0) == node for x in features(t, settings.short)})
            sites[None][node].append(fact)

    def importance(facts):
        pages = len(facts)
        if pages < 2:
            return 1.0
        spread = Counter(x for found, _ in facts for x in found)
        styles = Counter(style for _, style in facts)
        content = 1 - sum(math.log(n) for n in spread.values()) / len(spread) / math.log(pages)
        presentation = -sum(n / pages * math.log(n / pages) for n in styles.values()) / math.log(pages)
        return 1 - (1 - presentation) * (1 - content)

    low = set()
    for host, nodes in sites.items():
        for node, facts in nodes.items() if host is not None else ():
            if len(sites[None][node]) >= settings.few_pages:
                own, elsewhere, n = importance(facts), importance(sites[None][node]), len(facts)
                if (n * own + settings.borrowed * elsewhere) / (n + settings.borrowed) < settings.threshold:
                    low.add((host, node))
    return low


def test_importance_follows_its_definition(spark):
    rows = [(f"h{n % 3}.example", html) for n, _, html in varied_pages(each=14)[0]]
    rows += [("h0.example", page(n)) for n in range(9)] * 2
    df = spark.createDataFrame(rows, "host string, html string").repartition(3)
    for settings in (StyleTree(), StyleTree(threshold=0.55, borrowed=4, short=3), StyleTree(threshold=0.9, borrowed=0)):
        got = {(r["host"], r["node"] % (1 << 64)) for r in low_nodes(df, settings).collect()}
        assert got == plain_low(rows, settings) and got


def test_blocks_of_odd_markup():
    html = "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><P CLASS='x>y'>e&nbsp;f</P></div>g<!-- open"
    assert [b[0] for b in Page(html).blocks] == ["a", "b", "c", "d", "e f", "g"]


def test_common_prefix_is_rendered_once(spark):
    turn = "array<struct<turn:long,role:string,text:string>>"
    a = [(0, "user", "hi"), (1, "assistant", "yes")]
    b = [(0, "user", "hi"), (1, "assistant", "no"), (2, "user", None)]
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b), (4, [], [])], f"id long, chosen {turn}, rejected {turn}")
    got = {r["id"]: r for r in preference_format(df.selectExpr("*", "'x' AS prompt", "1 AS k")).collect()}
    one = got[1]
    assert one["n_shared"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["k"] == 1
    (span,) = one["chosen_mask"]
    assert one["chosen_text"][span["start"] : span["end"]] == "yes<|im_end|>"
    (span,) = one["rejected_mask"]
    assert one["rejected_text"][span["start"] : span["end"]] == "no<|im_end|>"
    assert one["rejected_text"].endswith("<|im_start|>user\n<|im_end|>\n")
    assert (got[2]["n_shared"], got[2]["chosen_text"], got[2]["chosen_mask"]) == (2, "", [])
    assert got[3]["n_shared"] == 0 and got[3]["chosen_text"] == "" and got[4]["prompt"] == ""


def test_pairs_from_a_table_of_turns(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", "q"), (1, 2, "user", "r"), (1, 3, "assistant", "B"), (2, 0, "user", "q"), (None, 0, "assistant", None)]
    got = {r["conv_id"]: r for r in stale_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [t["text"] for t in got[1]["rejected"]] == ["q", "A", "r", "A"] and got[1]["chosen"][-1]["text"] == "B"
    assert set(got) == {1, None} and got[None]["rejected"][0]["text"] == ""


def test_shards_take_turns():
    names, slots = [f"s{k}" for k in range(5)], 101

    def number(name, seed):
        return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)

    orders = [[(number(x, "offset") + j * (number(x, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for x in names]
    table: dict[int, int] = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            if len(table) < slots:
                table[next(s for s in order if s not in table)] = shard
    assert fill(names, slots) == [table[s] for s in range(slots)]
    assert max(Counter(table.values()).values()) - min(Counter(table.values()).values()) <= 1
    fewer = fill(names[:-1], slots)
    moved = sum(a != b for a, b in zip(fill(names, slots), fewer))
    assert moved < slots * 0.5


def test_rows_are_placed_by_key_alone(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (7, None)], "doc_id long, slot string")
    got = assigned(df, settings=Sharding(("x", "y", "z"), 101))
    assert got.columns == ["doc_id", "slot", "shard_no", "shard"] and got.count() == 5
    places = {}
    for r in got.collect():
        places.setdefault(r["doc_id"], set()).add((r["slot"], r["shard"]))
    assert all(len(x) == 1 for x in places.values())
    assert assigned(df.limit(0)).count() == 0
