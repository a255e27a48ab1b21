import random
import re

from earshot.operators import skew, threads as TH

MARKDOWN = """Title: A thread
Markdown Content:
menu
#### [Ann](https://f/members/1/)
##### Active Member
*   [Jan 1, 2024](https://f/threads/x.1/post-1)
*   [#1](https://f/threads/x.1/post-1)
> quoted
Hello [page](https://p)
![Image 1: pic](https://f/pic.png)
![:cool:](https://f/s.png)
Reactions: someone
#### Bob
*   [#2](https://f/threads/x.1/post-2)
Second body

### Similar threads
rest
"""


def test_two_posts(spark):
    docs = spark.createDataFrame([("1", MARKDOWN)], "thread_id string, markdown string")
    rows = TH.parse_posts(TH.lines_of(docs)).orderBy("post_no").collect()
    assert [r.post_no for r in rows] == [1, 2]
    first, second = rows
    assert (first.author, first.author_role, first.post_date, first.is_thread_starter) == ("Ann", "Active Member", "Jan 1, 2024", "是")
    assert (first.quote_text, first.post_text) == ("quoted", "Hello page")
    assert [tuple(i) for i in first.image_items] == [("https://f/pic.png", "pic")]
    assert (second.author, second.author_role, second.post_date, second.is_thread_starter, second.post_text) == ("Bob", "Active Member", "", "否", "Second body")


KINDS = ["#### [A{}](https://f/m)", "#### B{}", "#### Go to page {}", "#### ", "##### Role {}", "##### Thread Starter", "*   [Day {}](https://f/x/post-{})",
         "*   [Thread Starter {}](https://f/x/post-{})", "Thread Starter", "*   [#{}](https://f/post-{})", "*   [#{}](https://f/post-{})", "*   [#{}](broken",
         "### Similar threads {}", "text {}", "> quote {}", "text {}", ""]


def states(lines):
    """Line by line: number, link, author, role, date, starter mark and text of each post."""
    posts, inside, author, role, date, starter = [], None, "", "", "", "0"
    for s in lines:
        marker = re.match(r"\*\s+\[#(\d+)\]\(([^)]+)\)", s)
        if marker:
            inside = [int(marker[1]), marker[2], author or "Unknown", role, date, "是" if starter == "1" or marker[1] == "1" else "否", []]
            posts.append(inside)
            date, starter = "", "0"
            continue
        if s.startswith(("#### ", "### Similar threads")) or re.match(r"\*\s+\[#\d+\]\(", s):
            inside = None
        is_author = s.startswith("#### ") and len(s) > 5 and not s.startswith("#### Go to page")
        day = re.match(r"\*\s+\[([^\]#][^\]]*)\]\(([^)]+/post-\d+[^)]*)\)", s)
        if is_author:
            author, date = re.match(r"#### (?:\[([^\]]+)\]|(.+))", s).expand(r"\1\2").strip(), ""
        if inside is not None:
            inside[6].append(s)
        elif s.startswith("##### "):
            role = s[6:]
        elif day:
            date = day[1]
        elif not is_author and "Thread Starter" in s:
            starter = "1"
    return [(*p[:6], len([s for s in p[6] if s.startswith(">")]), [s for s in p[6] if s.startswith("text")]) for p in posts]


def test_posts_equal_a_reading_line_by_line(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_BITS", 2)  # threads cross many blocks
    draw = random.Random(5)
    threads = {str(t): [draw.choice(KINDS).replace("{}", str(draw.randint(1, 9))).strip() for _ in range(draw.choice([0, 1, 7, 60, 150]))] for t in range(60)}
    rows = [(t, 3 * i, s) for t, lines in threads.items() for i, s in enumerate(lines)]
    got = {}
    for r in TH.parse_posts(spark.createDataFrame(rows, "thread_id string, pos bigint, line string")).orderBy("thread_id", "post").collect():
        quotes = [q for q in r.quote_text.split("\n") if q]
        texts = [x for x in r.post_text.split("\n") if x.startswith("text")]
        got.setdefault(r.thread_id, []).append((r.post_no, r.post_url, r.author, r.author_role, r.post_date, r.is_thread_starter, len(quotes), texts))
    assert got == {t: found for t, lines in threads.items() if (found := states(lines))}
    assert sum(map(len, got.values())) > 200


def test_no_lines_no_posts(spark):
    assert TH.parse_posts(spark.createDataFrame([], "thread_id string, pos bigint, line string")).count() == 0


def test_lines_are_read_once_for_their_text(spark):
    docs = spark.createDataFrame([("1", MARKDOWN)], "thread_id string, markdown string")
    plan = TH.parse_posts(TH.lines_of(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
