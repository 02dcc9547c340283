"""Main text of web pages by composite text density.

Every element gets a density: characters per tag of its subtree, adjusted by the share of characters and tags
that are links, more strongly on pages with many links. An element's sum is that of its children's densities, its own
text counting as a child. The element with the largest sum is the centre of the main text. The least density on the
path from there up to the body is the threshold: elements elsewhere on the page that reach it belong to the text too.

Before that, parts that no article consists of are set aside: scripts, forms, menus, page headers, footers, sidebars,
hidden parts, and blocks whose class or id says advert, notice, comment and the like. Where a page marks its
article as such, the text is the whole of that article less those parts.

A null or empty page, and one without main text, has the empty text. Very long pages are read whole. Rows are
independent, so null or repeated keys and repeated rows need no rule; equal sums go to the element that comes first. An empty table gives
an empty result. Only the columns named are read; other columns may have any names.
"""

import math
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.common import byte_slices
from hearthgrid.llm.markup import BLOCK, BREAK, HEADINGS, Tree, attributes

# Elements, roles and words of class names that mark what is not part of an article.
ASIDE_TAGS = frozenset("""head title script style noscript template nav footer aside form button select textarea input dialog iframe
    object embed canvas audio video svg menu search datalist""".split())
ASIDE_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar
    form tablist""".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors
    promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay
    newsletter subscribe subscription signup login signin register paywall share sharing social sidebar sidebars aside rail
    nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar header masthead footer footers colophon copyright
    pagination pager related recommended recommendations trending widget widgets search skip""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond feedback reactions discussion".split())
# "no-sidebar" speaks of the page, "entry-header" of an article's own heading.
ABOUT_WORDS = frozenset("has no with without is not hide show js".split())
OWN_HEADER = frozenset("article entry post content story title section page".split())
COMMENT_HEADING = re.compile(
    r"(?:\d+ )?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?:?", re.I)

#: A block of links with this many other characters is no mere list.
LIST_REST = 200

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _class_words(found):
    """Words of the class names and the id, without names that speak about the page."""
    out = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] in ABOUT_WORDS:
            continue
        out.update(w for i, w in enumerate(words) if w != "header" or not i or words[i - 1] not in OWN_HEADER)
    return out


def _hidden(found):
    style = found.get("style", "").replace(" ", "").lower()
    return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Page:
    """A page's tree with the densities of its elements."""

    def __init__(self, page):
        self.tree = Tree(page)
        self.size = len(self.tree.name)
        self.alive = self._alive()
        self._measure()
        if self._drop_link_lists():
            self._measure()

    def _below(self, number, name):
        return any(self.tree.name[up] == name for up in self._path(number))

    def _path(self, number):
        """The element and all above it, up to the body."""
        while number >= 0:
            yield number
            number = self.tree.parent[number]

    def _alive(self):
        """For every element whether it can be part of the article."""
        tree, n = self.tree, self.size
        main, titled, wraps = bytearray(n), bytearray(n), bytearray(n)
        for i in range(n - 1, 0, -1):  # what an element holds, from the inside out
            up, name = tree.parent[i], tree.name[i]
            if name == "h1" or titled[i]:
                titled[up] = 1
            if main[i] or name == "main" or name == "article" and titled[i]:
                main[up] = 1
            if wraps[i] or name in ("main", "article", "nav", "footer"):
                wraps[up] = 1
        self.titled = titled
        alive, in_article, in_header = bytearray(n), bytearray(n), bytearray(n)
        alive[0] = 1
        for i in range(1, n):
            up, name = tree.parent[i], tree.name[i]
            in_article[i] = in_article[up] or name in ("article", "main")
            in_header[i] = in_header[up] or name == "header" and in_article[up]
            alive[i] = alive[up] and not self._aside(i, name, main[i], wraps[i], in_article[up])
        self.in_article, self.in_header = in_article, in_header
        self._end_at_comments(alive)
        return alive

    def _aside(self, i, name, holds_main, wraps, in_article):
        if name == "form":
            return not wraps  # some sites put a whole page into one form
        if name in ASIDE_TAGS or name == "header" and not in_article and not holds_main:
            return True
        if not self.tree.attributes[i] or name in ("a", "br"):
            return False
        found = attributes(self.tree.attributes[i])
        if _hidden(found):
            return True
        if name not in BLOCK:
            return False
        words = _class_words(found)
        if words & COMMENT_WORDS and not holds_main:
            return True
        if name in ("article", "main") or name in HEADINGS:
            return False
        return (found.get("role", "").lower() in ASIDE_ROLES or bool(words & ASIDE_WORDS)) and not holds_main

    def _end_at_comments(self, alive):
        """A heading that announces comments ends its parent's text there."""
        tree, heard, ended = self.tree, {}, {}
        for number, string in tree.text:
            if number > 0 and alive[number]:
                top = number if tree.name[number] in HEADINGS else tree.parent[number]
                if tree.name[top] in HEADINGS and len(heard.setdefault(top, "")) < 64:
                    heard[top] += string
        for number, string in heard.items():
            if tree.name[number] != "h1" and COMMENT_HEADING.fullmatch(" ".join(string.split())):
                ended.setdefault(tree.parent[number], number)
        if ended:
            for i in range(1, self.size):
                up = tree.parent[i]
                if not alive[up] or i >= ended.get(up, self.size):
                    alive[i] = 0

    def _measure(self):
        tree, n = self.tree, self.size
        own, chars, links, tags, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, bytearray(n)
        for i in range(1, n):
            linked[i] = linked[tree.parent[i]] or tree.name[i] == "a"
        all_chars = all_links = 0
        hushed = {"script", "style", "title"}
        for number, string in tree.text:
            if number >= 0 and tree.name[number] not in hushed:
                size = len(string) - string.count(" ") - string.count("\n")
                all_chars += size
                all_links += size if linked[number] else 0
                if self.alive[number]:
                    own[number] += size
        for i in range(n - 1, -1, -1):
            if not self.alive[i]:
                continue
            chars[i] += own[i]
            links[i] += own[i] if linked[i] else 0
            if i:
                up = tree.parent[i]
                is_link = tree.name[i] == "a"
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + is_link
        self.chars, self.links, self.own, self.linked = chars, links, own, linked
        self.share = all_links / all_chars if all_chars else 0.0
        self.density = [self.adjusted(chars[i], links[i], tags[i], link_tags[i]) if self.alive[i] else 0.0 for i in range(n)]
        sums, leaf = [0.0] * n, bytearray(b"\x01" * n)
        for i in range(n - 1, 0, -1):
            if self.alive[i]:
                sums[tree.parent[i]] += self.density[i]
                leaf[tree.parent[i]] = 0
        self.sums = [self.density[i] if leaf[i] else sums[i] + self.adjusted(own[i], own[i] if linked[i] else 0, 1, 0)
                     for i in range(n)]

    def _drop_link_lists(self):
        """Set aside blocks that are mostly links and hold little else, the inner ones first; not in marked articles."""
        tree, chars, links, tags, dropped = self.tree, [0] * self.size, [0] * self.size, [0] * self.size, bytearray(self.size)
        for i in range(self.size - 1, 0, -1):
            if not self.alive[i]:
                continue
            chars[i] += self.own[i]
            links[i] += self.own[i] if self.linked[i] else 0
            tags[i] += tree.name[i] == "a"
            if 2 * links[i] > chars[i] and tags[i] > 1 and chars[i] - links[i] < LIST_REST and tree.name[i] in BLOCK \
                    and not self.in_article[i]:
                dropped[i] = 1
                continue
            up = tree.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i]
        for i in range(1, self.size):
            if dropped[i] or not self.alive[tree.parent[i]]:
                self.alive[i] = 0
        return any(dropped)

    def adjusted(self, chars, links, tags, link_tags):
        """Composite text density: characters per tag, adjusted by links and by the page's share of links."""
        plain = chars / max(tags, 1)
        if not chars or not self.share:
            return plain
        odds = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
        base = math.log(chars / max(chars - links, 1) * links + self.share * chars + math.e)
        return max(plain * math.log(max(odds, 1.0)) / math.log(base), 0.0)

    def chosen(self):
        """For every element whether its text belongs to the main text."""
        tree, n = self.tree, self.size
        best = max(range(n), key=lambda i: (self.sums[i] if self.alive[i] else -1.0, -i))
        outer = [i for i in range(1, n) if self.alive[i] and tree.name[i] == "article" and not self._below(tree.parent[i], "article")]
        inside = [i for i in outer if i in set(self._path(best))] or self._best_article(outer, best)
        take = bytearray(n)
        if inside:
            for i in inside:
                take[i] = 1
        else:
            scope = next((i for i in self._path(best) if tree.name[i] == "main"), 0)
            self._take_dense(take, best, scope)
        for i in range(1, n):
            take[i] = self.alive[i] and (take[i] or take[tree.parent[i]])
        return take

    def _best_article(self, outer, best):
        """The marked article with the largest sum, if it has a title or a fair part of what the best element holds."""
        peaks = dict.fromkeys(outer, 0.0)
        top = [0] * self.size
        for i in range(1, self.size):
            top[i] = i if i in peaks else top[self.tree.parent[i]]
            if top[i] and self.alive[i]:
                peaks[top[i]] = max(peaks[top[i]], self.sums[i])
        found = max(outer, key=lambda i: (peaks[i], -i), default=None)
        fair = found is not None and (self.titled[found] or 4 * self.chars[found] >= self.chars[best])
        return [found] if fair else []

    def _take_dense(self, take, best, scope):
        """Mark the best element, what belongs around it, and other elements that reach the threshold."""
        tree = self.tree
        path = list(self._path(best))
        path = path[:path.index(scope) + 1]
        threshold = min(self.density[i] for i in path)
        headed = {tree.parent[i] for i in range(1, self.size) if self.alive[i] and tree.name[i] in HEADINGS}
        root = best
        while root != scope and tree.parent[root] != scope and tree.parent[root] in headed:
            root = tree.parent[root]
        above = set(path[path.index(root):])
        take[root] = 1
        for i in range(1, self.size):
            up = tree.parent[i]
            if not self.alive[i] or i in above:
                continue
            if up in above and up != root and tree.name[i] in BLOCK and self.chars[i] \
                    and (tree.name[i] in HEADINGS or self.density[i] >= threshold):
                take[i] = 1

    def text(self):
        """Blocks of the main text, in page order, with two line ends between them."""
        take, tree, blocks, now = self.chosen(), self.tree, [], []
        for number, string in [*tree.text, (BREAK, "")]:
            if number == BREAK:
                block = " ".join("".join(now).split())
                if block:
                    blocks.append(block)
                now = []
            elif take[number] and not self._byline(number):
                now.append(string)
        return "\n\n".join(blocks)

    def _byline(self, number):
        """Whether a text stands in an article's own header without being a heading."""
        return self.in_header[number] and not any(self.tree.name[i] in HEADINGS for i in self._path(number))


def main_text(page):
    """The main text of one page."""
    return Page(page).text() if page else ""


def extract(pages, keep=("page_id", "url"), html="html"):
    """The columns ``keep`` (others than text and n_chars), the main text and its length in code points."""
    slim = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).cast("string").alias("_html"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in byte_slices(batches, len(keep)):
            texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)
