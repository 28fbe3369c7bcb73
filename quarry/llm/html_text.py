"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once, left to right, into flat text blocks (text between block-level tags)
with numeric features: words and link density of the block and of its neighbours, whether
it lies in the page's article, outside it, in a structural container (nav, header,
footer, aside ...), in a form or in a container whose class or id names boilerplate, whether it is a
heading and whether the last heading announces comments. A decision tree (CART, Gini) grown on the
small labelled table below decides which blocks are main text; where a page has no article element, words and
link densities decide. The tree is grown on the driver from that fixed table and
sent to the tasks; pages stay where they are, there is no shuffle.

Class words are a hint, not a verdict on a subtree: words after a modifier (``has-sidebar``, ``tag-social``)
say nothing, and the page's first article or main element is told by itself, whatever the classes around it say.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

# Element names of the HTML standard by their part in a page.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is characters only, to their closing tag or the page's end; no text of them is kept.
RAW = "script style textarea title".split()
#: Elements that are dropped with all that they hold; an unclosed one ends with its parent.
DROPPED = set("template noscript svg math iframe object canvas select button audio video".split())
#: Of these a closing slash makes an empty element.
FOREIGN = set("svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
STRUCTURE = set("nav header footer aside menu dialog fieldset head search".split())
ARTICLE = set("article main".split())
#: Parts of class and id values that name boilerplate, and main text.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promoted promotion sidebar side aside "
    "rail widget comment comments commentlist disqus reply replies respond responses discussion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager "
    "copyright legal disclaimer skip tags toc outbrain taboola byline meta contentinfo complementary".split())
ARTICLE_WORDS = set("article content post entry story main articlebody entrycontent postcontent maincontent".split())
#: Words after which a class speaks of the page's layout or subject.
MODIFIERS = set("has no with without not is tag category cat layout hide show".split())
#: What headings above readers' comments say, in the four languages of the corpus.
COMMENT_HEADINGS = set("comment comments reply replies responses kommentar kommentare commentaire commentaires comentario comentarios".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|(?P<open><(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>?",
    re.S | re.I)
_HINT = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = ["words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density",
            "in_article", "outside_article", "structure", "form", "boiler_hint", "heading", "comments"]


@dataclass
class Block:
    text: str
    words: int
    links: int
    element: bool
    named: bool
    structure: bool
    form: bool
    boiler: bool
    heading: bool
    comments: bool
    features: list[float] = field(default_factory=list)


def _hint(rest: str) -> str:
    """'boiler', 'article' or '' by the element's class, id and role: values of one word before compound ones."""
    if _HIDDEN.search(rest):
        return "boiler"
    single, compound = set(), set()
    for m in _HINT.finditer(rest):
        for value in (m[1] or m[2] or m[3] or "").split():
            words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
            for i, word in enumerate(words):
                if word in MODIFIERS and i + 1 < len(words):
                    words = words[:i]
                    break
            if len(words) == 1 and not MODIFIERS.intersection(words):
                single.update(words)
            else:
                compound.update(words, ["".join(words)])
    for words in (single, compound):
        if BOILER_WORDS.intersection(words):
            return "boiler"
        if ARTICLE_WORDS.intersection(words):
            return "article"
    return ""


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks with their features; [] for a null, empty or textless page."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []  # open containers and what each says
    inside = {"element": 0, "named": 0, "structure": 0, "form": 0, "boiler": 0}
    around: dict[str, int] = {}  # what lies around the page's first article
    pieces: list[str] = []
    linked: list[str] = []
    in_link, heading, comments = False, False, False
    seen = {"element": False, "named": False}
    near: dict[str, int] = {}  # open elements that aren't on the stack
    dropped, within = "", []  # the element whose content is being dropped, and what is open in it

    def end_block() -> None:
        nonlocal comments
        if pieces:
            words = entities.unescape("".join(pieces)).split()
            if words:
                links = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                if heading:
                    comments = len(words) <= 6 and not COMMENT_HEADINGS.isdisjoint(w.strip(".,:;()").lower() for w in words)
                out.append(Block(" ".join(words), len(words), min(links, len(words)), inside["element"] > 0, inside["named"] > 0,
                                 inside["structure"] > 0, inside["form"] > 0, inside["boiler"] > 0, heading, comments))
            pieces.clear()
            linked.clear()

    def leave(kind: str) -> None:
        if kind == "first":
            inside["element"] -= 1
            for k, n in around.items():
                inside[k] += n
        elif kind:
            inside[kind] -= 1

    def text(part: str) -> None:
        if part and not dropped:
            pieces.append(part)
            if in_link:
                linked.append(part)

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["name"]
        if tag is None:
            if m["open"] and m["open"].endswith("/>") and FOREIGN.intersection([dropped, *within]):
                at = m.end("open")  # <title/> in an image is empty
            continue
        tag = tag.lower()
        if dropped:
            if not m["close"]:
                if tag not in VOID and not m["rest"].endswith("/"):
                    within.append(tag)
                continue
            if tag in within:
                while within.pop() != tag:
                    pass
                continue
            if tag == dropped:
                dropped = ""
                continue
            if not near.get(tag) and all(tag != name for name, _ in stack):
                continue
            dropped = ""  # what holds it ends
            within.clear()
        elif tag in DROPPED:
            if not m["close"] and not (tag in FOREIGN and m["rest"].endswith("/")):
                dropped = tag
                within.clear()
            continue
        if m["close"]:
            if near.get(tag):
                near[tag] -= 1
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                end_block()
                if tag[0] == "h" and tag[1:].isdigit():
                    heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, kind in stack[i:]:
                        leave(kind)
                    del stack[i:]
                    break
            continue
        rest = m["rest"]
        if tag == "a":
            in_link = True
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            end_block()
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                leave(stack.pop()[1])
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                heading = True
            elif heading:
                heading = False
        if tag in VOID or rest.endswith("/"):
            continue
        hint = _hint(rest) if "=" in rest or "hidden" in rest else ""
        kind = hint if hint == "boiler" else ""
        if tag in STRUCTURE:
            kind = "structure"
            if tag == "header" and inside["element"]:
                kind = ""  # an article's own header holds its title
        elif tag == "form":
            kind = "form"
        elif not kind and tag in ARTICLE:
            kind = "element"
        elif hint == "article" and tag in BLOCK and not (inside["structure"] or inside["boiler"]):
            kind = "named"
        if tag in ("html", "body"):
            near[tag] = 1
            continue
        if kind == "element" and not seen["element"] and not inside["structure"]:
            kind = "first"
            around.update({k: inside[k] for k in ("form", "boiler")})
            inside.update(form=0, boiler=0)
        if kind in ("first", "element", "named") and not (inside["structure"] or inside["boiler"]):
            seen["named" if kind == "named" else "element"] = True
        if kind or tag in BLOCK and tag != "p":
            stack.append((tag, kind))
            if kind:
                inside["element" if kind == "first" else kind] += 1
        else:
            near[tag] = 1 if tag == "p" else near.get(tag, 0) + 1
    if at < len(page):
        text(page[at:])
    end_block()

    density = [b.links / b.words for b in out]
    for i, b in enumerate(out):
        before, after = (out[i - 1] if i else None), (out[i + 1] if i + 1 < len(out) else None)
        b.features = [
            b.words, density[i], before.words if before else 0, density[i - 1] if before else 0.0,
            after.words if after else 0, density[i + 1] if after else 0.0,
            2.0 * b.element if seen["element"] else float(b.named),
            float(not b.element if seen["element"] else seen["named"] and not b.named),
            float(b.structure), float(b.form), float(b.boiler), float(b.heading), float(b.comments)]
    return out


# The small labelled table: pages whose blocks begin with "+" (main text) or "-" (boilerplate).
LABELLED = [
    "<title>- t</title><nav><ul><li><a>- home</a><li><a>- the news</a></ul></nav><div class=ad>- buy this fine thing now and here.</div>"
    "<article><h1>+ a title of a page</h1><p>+ short.<p>+ some longer text that goes on for a while and says more about it all.<p>+ and <a>so on</a> to its end."
    "</article><footer>- &copy; a site, all rights reserved by us.</footer>",
    "<header><h1>- the site</h1><p>- news for all of us</p></header><main><h2>+ what was said</h2><p>+ one two three four five six seven eight nine ten."
    "<p>+ yes.<aside><p>- read this too, it is about the same thing and quite long as it happens.</aside><p>+ more of it.</main>"
    "<section id=comments><h3>- two readers wrote</h3><p>- i liked this text a lot, it was good to read in the morning.<p>- no.</section>",
    "<div id=content><p>+ a text without an article element, which is long enough to be seen as one by its words.<p>+ it has <a>a link</a> and goes on after it for a bit more."
    "<p>+ end.</div><div class=sidebar><ul><li><a>- one</a><li><a>- two of them</a><li><a>- three</a></ul><p>- about the one who writes here for you</div>",
    "<div><a>- home</a> <a>- about</a> <a>- write</a></div><div><p>+ plain old pages have no classes at all, only text in paragraphs like this one here.</p>"
    "<p>+ they go on with further words, many of them, so that density tells what they are at last.</p></div><div><a>- next</a> <a>- last page</a></div>",
    "<article><h1>+ title</h1><ul><li>+ an item</ul><p>+ <a>all of this is a link</a><blockquote>+ quoted words of one of them</blockquote><form><p>- your name and your mail please<input></form>"
    "<div class='cookie-notice'>- we use cookies to make it better for all of you who come.</div><p>+ last words.</p></article>"
    "<div class=related><h3>- see also</h3><p>- another story with a rather long description under it, as they have.</div>",
    "<nav><p>- you are here in the middle of a long sentence that is set in the menu.</nav><main><p>+ ok.</main><aside>- one.</aside>"
    "<form><label>- find</label></form><footer><p>- terms and more words of the kind that nobody reads at the end of a page.</footer>",
    "<article><h1><a>+ a title that is a link</a></h1><p><a>+ one whole paragraph that is a link</a><p>+ words.<ul><li><a>+ a source</a></ul></article>",
    "<article><header><h1>+ a heading in its own header</h1></header><p>+ text.</p><table><tr><td>+ a cell<td>+ and another</table>"
    "<footer>- written by them</footer></article><div>- shown outside of it, some words here.</div><p>- and a longer one outside of the article with more words to it.</p>",
    # no article element and no class: words and links tell
    "<ul><li><a>- home</a><li><a>- world news</a><li><a>- sport</a><li><a>- write to us</a></ul><h1>+ a title of seven words as such</h1><p>+ this text has neither an article nor "
    "a class, so that its words and the lack of links in it have to tell what it is.<p>+ short.<p>+ after a short one a long one comes again, with words enough to be taken for what it is."
    "<h2>+ next part</h2><p>+ it ends with <a>one link</a> in a sentence of quite a few words, as sentences in a text so often do.<ul><li><a>- terms</a><li><a>- imprint</a><li><a>- help</a></ul><p>- all rights reserved</p>",
    "<div>- the daily sheet</div><div><a>- home</a> <a>- two</a></div><div><a>- three</a></div><div><p>+ here the text begins with a sentence of many words that says what will be said.</p>"
    "<p><a>+ a paragraph that is one link</a></p><p>+ and it goes on with another sentence of many words that says what was said before it.</p></div>"
    "<div>- more:</div><div><a>- one story</a></div><div><a>- another story with a long title that somebody wrote to have it clicked</a></div><div><a>- a third story</a></div><div>- &copy; the sheet</div>",
    "<table><tr><td><a>- index</a><td><a>- search it</a><td><a>- mail</a></table><p>+ old pages are tables, and what is said in them stands in paragraphs that have words enough.<p>+ yes, that is so.<p>+ to the end of it "
    "there are more words, so it is a text like any other of this kind.<hr><p>- <a>back</a> or <a>up</a> or <a>home again</a>",
    "<div><p>+ a page of nothing but text has no menu at all, and all that it says is kept as it is.</p><p>+ so it is with this one, whose second paragraph is its last and has no neighbour after it.</p></div>",
    "<div><a>- all posts</a></div><h1>+ how it went</h1><p>+ we went out in the morning and came back when it was dark, and that was all there was to it.<p>+ it was good.<p>+ no more to say but that we would do it again "
    "at any time, all of us.<h3>- two comments</h3><p>- i was there too and i liked it as much as you did, so write more of this kind.<p>- me too.<p>- nice words, thank you for them, they made my day a better one.",
    "<article><h2>+ comments on the law</h2><p>+ this article has a part on what was said about the law, which is text like the rest of it.</article>",
    "<div><a>- home</a></div><div><a>- tales</a></div><div><a>- poems</a></div><h1>+ the rain</h1><p>+ he came.<p>+ she went home again.<p>+ nobody saw the two of them there.<p>+ it rained all day.<p>+ so they said."
    "<p>+ it rained all night, too, and then no more.<p>+ the end.<p>+ or not quite.<p>- written in <a>may</a></p><div><a>- one tale back</a></div><div><a>- the next tale</a></div>",
    "<div><a>- dishes</a> <a>- cakes</a></div><div><a>- soups</a></div><h2>+ a cake</h2><ul><li>+ two eggs<li>+ a cup of milk<li>+ some salt<li>+ three spoons of sugar</ul><p>+ stir it well.<p>+ bake it for an hour.<p>+ let it cool."
    "<p>+ eat it with those you like, and do not forget to keep a piece of it for the next day.<p>- see also:<ul><li><a>- soup of the day</a><li><a>- bread</a></ul><p>- made by us",
    "<p>- you are here:<p><a>- home</a><p><a>- letters</a><h1>+ dear friend</h1><p>+ thank you.<p>+ i am well.<p>+ how are you?<p>+ write soon, will you?<p>+ yours<p><a>- back to all letters</a><p><a>- top</a>",
    "<h1>+ a list</h1><p>+ first.<p>+ second of them.<p>+ third.<ol><li>+ here.<li>+ there and everywhere.</ol>",
    "<p>+ a first paragraph of a great many words, since texts have long paragraphs as well as short ones, and this one is to be longer than all those that came before it in this table of pages.<p><a>+ a line that is one link</a>"
    "<p>+ a second paragraph of a great many words, since texts have long paragraphs as well as short ones, and so a link between the two of them is a part of what is said here.<div><a>- imprint</a></div><div><a>- all of it</a></div>",
    "<div><a>- page one</a></div><div><a>- page two</a></div><p>+ forty words or so make a paragraph that is longer than most, and whoever writes one has something to say, or so one hopes when one begins to read it in the evening after a day of work.<p>+ it ends.<p><a>+ the source of it</a><p>+ with many thanks "
    "to all of those who have read it to its end, and who now go to bed with it.<p><a>- up</a><p><a>- down</a>",
    "<article><p>+ see.<p><a>+ a link</a><p>+ and see.<ul><li><a>+ here</a><li><a>+ there</a></ul></article>",
    "<article><p>+ it is told.<p><a>+ in a link</a><p>+ told.</article>", "<article><p>+ told by <a>one of them</a></article>",
    "<article><h1>+ so</h1><ul><li><a>+ a link</a><li><a>+ another</a></ul><p>+ written in <a>may of last year</a></article>",
    "<article><p>+ one line.</article>",
    "<article><h1>+ short</h1><p>+ yes.<p>+ last words of it.</article>",
    "<main><p>+ a line.<p>+ another line <a>to see</a></main>",
    "<div class=post><h1>+ told by a class</h1><p>+ short.<p>+ and its end.</div>",
    # a class that names the content around a menu and links
    "<div id=main><ul><li><a>- start</a><li><a>- all of it</a><li><a>- last</a></ul><p>+ the class names the content here, but the menu lies in it, too, so that links tell.<p>+ fine.<p>+ there are more words to come in this "
    "third paragraph of it, which is long.<div><a>- older post</a></div><div><a>- newer post of them</a></div></div>",
    "<div class=content><div><a>- a</a> <a>- b</a></div><div><a>- c and d</a></div><h1>+ told by a class</h1><p>+ some words of text stand here in a sentence that is long enough, as they do.<p><a>+ a linked line</a><p>+ and after it again "
    "some words of text in a sentence that is long enough.</div><div>- beside it some words</div>",
    # a form around the whole page, and forms in it
    "<form id=aspnet><div><a>- home</a></div><div><a>- shop for all</a></div><p>+ some servers write a form around the whole page, so that a form says little of long texts like this one.<p>+ nor of what follows it with as many "
    "words as this sentence has, or nearly.<div><a>- imprint</a></div></form>",
    "<p>+ a text of many words, then a form in which one may write to those who wrote it, if one likes.<form><p>- your name<input><p>- your message to us<textarea></textarea><p>- send</form>",
    # layout classes, comments in plain classes, related articles
    "<div class='page-wrap has-sidebar'><article class='post tag-social'><header class=entry-header><h1>+ a title</h1></header><p>+ words.</article><div class=thread><p>- a reader's words about it, quite a few of them in a row.</div></div>",
    "<form><div class=widget><main><p>+ one.<div class=share><p>- send it on</div><p>+ two words.</main></div></form><section class=responses><p>- somebody has answered with a rather long sentence here.</section>",
]


def grow(rows: list[list[float]], labels: list[bool], depth: int = 24) -> tuple:
    """A CART tree: (feature, threshold, low, high) or (share of main text,)."""
    share = sum(labels) / len(labels)
    if share in (0.0, 1.0) or not depth:
        return (share,)

    def gini(some: list[bool]) -> float:
        p = sum(some) / len(some)
        return len(some) * p * (1 - p)

    best = None
    for k in range(len(rows[0])):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left = [y for r, y in zip(rows, labels) if r[k] <= cut]
            right = [y for r, y in zip(rows, labels) if r[k] > cut]
            loss = gini(left) + gini(right)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, k, cut)
    if best is None or best[0] >= gini(labels) - 1e-12:
        return (share,)
    _, k, cut = best
    low = [(r, y) for r, y in zip(rows, labels) if r[k] <= cut]
    high = [(r, y) for r, y in zip(rows, labels) if r[k] > cut]
    return (k, cut, grow(*map(list, zip(*low)), depth - 1), grow(*map(list, zip(*high)), depth - 1))


def labelled_table(pages: list[str] = LABELLED) -> tuple[list[list[float]], list[bool]]:
    rows = [b for page in pages for b in blocks(page)]
    return [b.features for b in rows], [b.text[0] == "+" for b in rows]


def is_main(tree: tuple, features: list[float]) -> bool:
    while len(tree) > 1:
        k, cut, low, high = tree
        tree = low if features[k] <= cut else high
    return tree[0] > 0.5


def main_text(page: str | None, tree: tuple) -> str:
    """Main-text blocks in page order, joined by one newline; empty if there are none."""
    return "\n".join(b.text for b in blocks(page) if is_main(tree, b.features))


def extract_text(pages: DataFrame, html: str = "html", tree: tuple | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every row of ``pages``; the html column goes.

    Null, empty or textless html: empty text. Broken markup never fails: unclosed elements
    end with what holds them, a ``<`` that begins no tag is text. Repeated rows stay; an
    empty table gives no rows; the input's own columns text and n_chars are replaced.
    """
    tree = tree or grow(*labelled_table())
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    rows = pages.select(*kept, F.col(html).alias(html))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)
    return rows.mapInArrow(run, fields + "text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
