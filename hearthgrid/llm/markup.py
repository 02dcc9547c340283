"""A lenient reader of HTML: the elements of a page as a tree in arrays, and its text in page order.

Tags may be missing, crossed or cut off. What a page leaves open is closed where HTML says so; an
unfinished tag, comment or script at the end is dropped with what follows. Every scan moves forward, so odd pages cost no
more than their length.
"""

import html
import re

# Element names as HTML groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul colgroup""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
# A start tag ends open elements of these names, up to an element of the second group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}), "a": ({"a"}, {"td", "th", "li"}),
    **{n: ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}) for n in ("tbody", "thead", "tfoot")}}
SCOPES = {"table", "td", "th", "caption", "button", "template", "object"}

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_COMMENT = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}

BREAK = -1


class Tree:
    """Elements by number in page order: ``parent``, ``name`` and ``attributes`` (as text); 0 is the body.

    ``text`` holds (number of element, string) in page order; BREAK stands where a block begins or ends.
    """

    def __init__(self, page):
        self.parent, self.name, self.attributes, self.text = [-1], ["body"], [""], []
        self._stack, self._open = [0], {}
        self._read(page)

    def _push(self, name, attributes):
        self.parent.append(self._stack[-1])
        self.name.append(name)
        self.attributes.append(attributes)
        self._stack.append(len(self.name) - 1)
        self._open[name] = self._open.get(name, 0) + 1

    def _close(self, names, borders):
        """Close the innermost open element of these names, unless one of the borders comes first."""
        if not any(self._open.get(n) for n in names):
            return
        for at in range(len(self._stack) - 1, 0, -1):
            name = self.name[self._stack[at]]
            if name in names:
                for number in self._stack[at:]:
                    self._open[self.name[number]] -= 1
                del self._stack[at:]
                return
            if name in borders:
                return

    def _start(self, name, attributes):
        if name in ("html", "body"):
            self._close({"head"}, ())
            return
        if self._open.get("head") and name not in HEAD_ONLY:
            self._close({"head"}, ())
        if name in BLOCK:
            self.text.append((BREAK, ""))
            self._close({"p"}, SCOPES)
        if name in ENDS:
            names, borders = ENDS[name]
            for _ in names:
                self._close(names, borders)
        self._push(name, attributes)
        if name == "br":
            self.text.append((self._stack[-1], " "))
        if name in VOID:
            self._stack.pop()
            self._open[name] -= 1

    def _end(self, name):
        if name in ("html", "body"):
            return
        if name in BLOCK:
            self.text.append((BREAK, ""))
        self._close({name}, SCOPES - {name} if name in BLOCK else BLOCK - {name})

    def _data(self, string):
        if "&" in string:
            string = html.unescape(string)
        if self._open.get("head") and not string.isspace():
            self._close({"head"}, ())
        self.text.append((self._stack[-1], string))

    def _read(self, page):
        at = 0
        while True:
            opened = _OPEN.search(page, at)
            if opened is None:
                if at < len(page):
                    self._data(page[at:])
                return
            here = opened.start()
            if here > at:
                self._data(page[at:here])
            if page.startswith("<!--", here):
                ended = _COMMENT.search(page, here + 2)
                if ended is None:
                    return
                at = ended.end()
                continue
            tag = _TAG.match(page, here)
            if tag is None:
                odd = page[here + 1] in "!?" or not page[here + 2:here + 3].isalpha() and page[here + 1] == "/"
                at = page.find(">", here) + 1
                if not odd or not at:
                    return
                continue
            at, name = tag.end(), tag.group(1).lower()
            if page[here + 1] == "/":
                self._end(name)
                continue
            self._start(name, tag.group(2))
            foreign = self._open.get("svg") or self._open.get("math")
            if foreign and page[at - 2] == "/" and name not in VOID:
                self._close({name}, ())
            elif name in RAW and not foreign:
                ended = _RAW_END[name].search(page, at)
                if ended is None:
                    return
                at = ended.start()


def attributes(string):
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(string):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found
