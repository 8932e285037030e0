"""A page's element tree, the features of its elements, and the text blocks of those that are kept."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Element names of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title iframe svg math canvas object audio video select option textarea button datalist".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = set(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"ul", "ol", "dl", "table", "menu", "div", "section", "article", "body", "html", "main", "aside", "nav", "form", "blockquote"}
TAG_GROUPS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dt dd", "nav", "aside", "header", "footer",
              "form fieldset label", "table tbody tr td th thead tfoot", "a", "blockquote pre figure figcaption", "html body"]
TOKEN_GROUPS = [
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination tabs toc",
    "header masthead topbar top banner logo branding tagline",
    "footer foot bottom copyright colophon legal credits",
    "sidebar side aside rail secondary widget widgets column",
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion promoted dfp",
    "notice cookie cookies consent gdpr alert popup modal overlay announcement message warning paywall",
    "form search newsletter subscribe subscription signup login register",
    "comment comments commentlist reply replies respond discussion disqus feedback reviews",
    "share sharing social related recommended recommendations more popular trending tags meta byline author links",
    "article post entry story news blog",
    "content main body text page maincontent",
]
_GROUP_OF_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_GROUP_OF_TOKEN = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_BAD, _GOOD = range(9), range(9, 11)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = len(TAG_GROUPS) + len(TOKEN_GROUPS) + 18
MARK = "data-k"  # labels of sample pages; never a feature


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.groups, self.marks, self.hidden = ["#root"], [-1], [()], [None], [False]
        self.open = [0]
        self.body, self.implied = 0, False
        self.flow: list[tuple[int, str | None]] = []  # texts of elements, and None where a block begins or ends

    def _push(self, tag, attrs):
        a = dict(attrs)
        words = _TOKEN.findall(f"{a.get('class') or ''} {a.get('id') or ''} {a.get('role') or ''}")
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.groups.append(tuple({g for w in words if (g := _GROUP_OF_TOKEN.get(w.lower())) is not None}))
        self.marks.append(a.get(MARK))
        gone = tag in HIDDEN or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style") or "") is not None
        self.hidden.append(gone or self.hidden[self.open[-1]])
        return len(self.tags) - 1

    def _close(self, names, stops):
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[k]]
            if tag in names:
                for i in self.open[k:]:
                    if self.tags[i] in BLOCK:
                        self.flow.append((i, None))
                        break
                del self.open[k:]
                return
            if tag in stops:
                return

    def _leave_head(self):
        """What can't stand in an open head ends it."""
        if self.tags[self.open[-1]] == "head":
            self._close({"head"}, ())

    def _imply_body(self):
        self.body, self.implied = self._push("body", []), True
        self.flow.append((self.body, None))
        self.open.append(self.body)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            if self.implied and len(self.open) == 2 and self.open[1] == self.body:
                self.open.pop()
        elif tag not in IN_HEAD:
            self._leave_head()
            if len(self.open) == 1 and not self.body and "html" not in self.tags:
                self._imply_body()
        if tag in BLOCK and tag != "body" and tag != "html":
            self._close({"p"}, SCOPE | {"td", "th", "li"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE - {"div"} if tag != "li" else SCOPE)
        if tag == "br":
            self.flow.append((self.open[-1], " "))
            return
        if tag == "body":
            self._close({"head"}, ())
        node = self._push(tag, attrs)
        if tag == "body":
            self.body, self.implied = node, False
        if tag in BLOCK:
            self.flow.append((node, None))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, () if tag in BLOCK or tag in HIDDEN else BLOCK)

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
            if len(self.open) == 1:  # text beside all elements belongs to the body
                if not self.body:
                    self._imply_body()
                self.flow += [(self.body, None), (self.body, data)]
                return
        self.flow.append((self.open[-1], data))


class Page:
    """Arrays over a page's elements in page order; 0 is the root."""

    def __init__(self, html: str):
        b = _Builder()
        b.feed(html.removeprefix("\ufeff"))
        b.close()
        self.tags, self.parents, self.flow = b.tags, b.parents, b.flow
        self.groups, self.marks, self.hidden = b.groups, b.marks, b.hidden

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own, link, stops, words = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        texts = [0] * n
        for i, t in self.flow:
            if t is not None and not self.hidden[i] and (size := len(s := t.strip())):
                own[i] += size
                texts[i] += 1
                words[i] += s.count(" ") + 1
                stops[i] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
        total, anchor, punct, pieces = own[:], [0.0] * n, stops[:], [float(x) for x in texts]
        below, kids, index, links = [0] * n, [0] * n, [0] * n, [0] * n
        paragraphs, longest, wordy = [0] * n, own[:], words[:]
        depth, bad, good, in_bad, in_good = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = self.parents[i]
            index[i] = kids[p]
            kids[p] += 1
            depth[i] = depth[p] + 1
            tag = self.tags[i]
            is_bad = any(g in _BAD for g in self.groups[i]) or tag in ("nav", "aside", "footer", "form")
            is_good = any(g in _GOOD for g in self.groups[i]) or tag in ("article", "main")
            in_bad[i], in_good[i] = in_bad[p] + bad[p], in_good[p] + good[p]
            bad[i], good[i] = int(is_bad), int(is_good)
        article = float(any(g and not x for g, x in zip(good, self.hidden, strict=True)))
        for i in range(n - 1, 0, -1):
            p, tag = self.parents[i], self.tags[i]
            if tag == "a":
                anchor[i], links[i] = total[i], links[i] + 1
            if tag == "p":
                paragraphs[i] += 1
            total[p] += total[i]
            anchor[p] += anchor[i]
            punct[p] += punct[i]
            pieces[p] += pieces[i]
            wordy[p] += wordy[i]
            links[p] += links[i]
            below[p] += below[i] + 1
            paragraphs[p] += paragraphs[i]
            longest[p] = max(longest[p], longest[i])
        x = np.zeros((n, FEATURES), np.float32)
        for i in range(n):
            if (g := _GROUP_OF_TAG.get(self.tags[i])) is not None:
                x[i, g] = 1
            for g in self.groups[i]:
                x[i, len(TAG_GROUPS) + g] = 1
        t, k = np.array(total), np.array(kids)
        parent = np.maximum(np.array(self.parents), 0)
        rest = [np.log1p(t), np.array(anchor) / np.maximum(t, 1), t / (np.array(below) + 1), np.array(punct) / np.maximum(t, 1) * 100,
                t / max(1.0, total[0]), np.array(depth), np.array(index) / np.maximum(k[parent], 1), np.log1p(k[parent]), np.log1p(k),
                np.log1p(own), np.log1p(longest), np.log1p(links), np.log1p(paragraphs), np.array(in_bad), np.array(in_good),
                t / np.maximum(np.array(wordy), 1), t / np.maximum(np.array(pieces), 1), np.full(n, article)]
        x[:, len(TAG_GROUPS) + len(TOKEN_GROUPS) :] = np.stack(rest, 1)
        return x

    def labels(self) -> np.ndarray:
        """Of a sample page: 1 for elements with main text inside."""
        n = len(self.tags)
        flag: list[str | None] = [None] * n
        for i in range(1, n):
            flag[i] = self.marks[i] or flag[self.parents[i]]
        y = [int(f == "1") for f in flag]
        for i in range(n - 1, 0, -1):
            y[self.parents[i]] |= y[i]
        return np.array(y)

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """Kept elements with the best sum of log odds such that each kept one's parents are kept."""
        n = len(self.tags)
        gain = log_odds.tolist()
        gain[0] = 0.0
        for i in range(n - 1, 0, -1):
            if not self.hidden[i] and gain[i] > 0:
                gain[self.parents[i]] += gain[i]
        kept = [True] + [False] * (n - 1)
        for i in range(1, n):
            kept[i] = kept[self.parents[i]] and gain[i] > 0 and not self.hidden[i]
        return kept

    def text(self, kept: list[bool]) -> str:
        """Blocks of kept elements in page order, white space as one space, joined by two line breaks."""
        blocks, now = [], []
        for i, t in self.flow:
            if t is None:
                blocks.append("".join(now))
                now = []
            elif kept[i] and i:
                now.append(t)
        blocks.append("".join(now))
        return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)
