"""Made-up pages with known blocks, to train and test the block labeller on."""

from __future__ import annotations

import random
import re

#: Ways in which a page is laid out: with telling names; by tags alone; by roles; with names that tell nothing; of div only; in the
#: cells of a table; with the article straight in the body. And how often.
FAMILIES = {"named": 5, "tags": 2, "roles": 2, "hashed": 4, "divs": 3, "cells": 3, "bare": 3}
#: Families whose tags don't tell what is an article, so that texts have to.
UNTOLD = {"hashed", "divs", "cells", "bare"}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "article": "article", "main": "main", "form": "search"}
TAG = re.compile(r"<(/?)([a-z0-9]+)([^>]*)>")
NAMED = re.compile(r' (?:class|id)="[^"]*"')
#: Words that pages say outside their articles.
CUES = {
    "nav": "home about us contact news sport menu archive login log in register sign up search help faq accueil kontakt inicio startseite produkte services products blog category categories tags shop cart account world politics business culture travel science weather video photos jobs events team press support skip to content next previous page back top".split(),
    "notice": "we use cookies to improve your experience accept all privacy policy settings consent cookie zustimmen aceptar accepter javascript is required please enable notice browser outdated".split(),
    "ad": "advertisement sponsored buy now special offer sale discount free shipping limited click here subscribe deal anzeige publicidad publicite promo".split(),
    "footer": "copyright all rights reserved all rights reserved terms of use service imprint impressum privacy policy sitemap powered by contact company inc ltd llc gmbh alle rechte vorbehalten tous droits réservés todos los derechos reservados 2019 2020 2021 2022 2023 2024".split(),
    "form": "email address password sign up subscribe newsletter send name submit your message remember me log in search".split(),
    "side": "related articles most read popular posts recent comments trending you may also like more from tags authors latest".split(),
    "share": "share tweet facebook twitter email print whatsapp like follow us pin".split(),
    "comments": "reply comments says posted by ago likes report leave a comment kommentar respuesta guest user wrote".split(),
    "byline": "by author published updated minutes read posted on editor".split(),
}
SYLLABLES = "a an ar at au be bo ca ch ci co de di do e ea ed el en er es eu ga ge gi ha he hi ho i in ing is it ja ka ke la le li lo ly ma me mi mo na ne ni no nt o on or ou pa pe po qu ra re ri ro sa sch se si so st sto ta te th ti to tion tre tu u un ur va ve vi vo wa we wh y z ze é è ñ ü ä ö ß ó".split()
SHORT = "the of and to a in is it on as at by or de la le un et der die und das el los que en".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.family = "named"

    def word(self) -> str:
        r = self.r
        return r.choice(SHORT) if r.random() < 0.35 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(self, n: int | None = None) -> str:
        r = self.r
        words = [self.word() + ("," if r.random() < 0.08 else "") for _ in range(n or r.randint(2, 22))]
        return " ".join(words).capitalize() + r.choice("....!?")

    def heading(self, n: int) -> str:
        """A sentence, mostly without its full stop."""
        text = self.sentence(n)
        return text if self.r.random() < 0.3 else text.rstrip(".!?").replace(",", "")

    def prose(self, most: int = 6) -> str:
        r = self.r
        text = self.sentence(r.randint(1, 3)) if r.random() < 0.12 else " ".join(self.sentence() for _ in range(r.randint(1, most)))
        kind = r.random()
        if kind < 0.12:  # tables, ratings and other odd texts
            sign = r.choice(["***", "!!", "%%%", "&amp;", " |", " |", "$$", ";", ",", " -", "#", " &middot;"])
            text = " ".join(w + (sign if r.random() < 0.8 else "") for w in text.split())
        elif kind < 0.16:
            text = " ".join(w for w in text.split()[:12] for _ in range(r.randint(1, 8)))
        elif kind < 0.20:
            text = " ".join(str(r.randint(0, 10 ** r.randint(1, 6))) + r.choice(["", ",", " km", "%"]) if r.random() < 0.5 else w for w in text.split())
        elif kind < 0.24:
            text = text.lower().rstrip(".!?")
        return text.upper() if r.random() < 0.04 else text

    def cue(self, kind: str, lo: int = 1, hi: int = 5) -> str:
        r = self.r
        known = 0.6 if self.family not in UNTOLD else 0.85
        words = [r.choice(CUES[kind]) if r.random() < known else self.word() for _ in range(r.randint(lo, hi))]
        return " ".join(words).capitalize()

    def attrs(self, names: str, chance: float = 1.0) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names.split())
        if r.random() < 0.25:
            name += r.choice(["-1", "-main", "-wrap", "-box", "_inner", " clearfix", " row", "-top"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    # each part gives a list of (markup, text or None, is content)

    def links(self, kind: str, lo: int, hi: int) -> list:
        r, out = self.r, []
        for _ in range(r.randint(lo, hi)):
            text = self.cue(kind, 1, 3) if r.random() < 0.5 else self.word().capitalize() if r.random() < 0.6 else self.sentence(r.randint(2, 7))
            out += [("<li>", None, 0), (f'<a href="/{r.randint(1, 99)}">{text}</a>', text, 0), ("</li>", None, 0)]
        return [("<ul>", None, 0), *out, ("</ul>", None, 0)]

    def wrap(self, tag: str, attrs: str, inner: list) -> list:
        return [(f"<{tag}{attrs}>", None, 0), *inner, (f"</{tag}>", None, 0)]

    def text(self, tag: str, text: str, content: int, attrs: str = "") -> list:
        return [(f"<{tag}{attrs}>{text}</{tag}>", text, content)]

    def boilerplate(self, kind: str) -> list:
        r = self.r
        some = lambda *options: r.choice(options)()
        say = lambda cue: self.cue(cue, 2, 12) if self.family in UNTOLD or r.random() < 0.55 else self.prose(2)
        if kind == "nav" and r.random() < 0.3:  # links side by side are one text
            texts, between = [self.cue("nav", 1, 2) for _ in range(r.randint(2, 8))], r.choice([" ", "", " | ", "\n", " / "])
            text = " ".join(between.join(texts).split())
            return self.wrap(r.choice(["div", "nav", "p", "div"]), self.attrs("nav menu links topbar", 0.5), [(between.join(f'<a href="/{k}">{t}</a>' for k, t in enumerate(texts)), text, 0)])
        if kind == "nav":
            tag, attrs = r.choice([("nav", self.attrs("nav menu main-nav", 0.4)), ("div", self.attrs("nav menu navbar main-menu topnav breadcrumb breadcrumbs pagination")), ("ul", self.attrs("menu nav links"))])
            return self.wrap(tag, attrs, self.links("nav", 2, 9))
        if kind == "header":
            inner = some(lambda: self.text("a", self.cue("nav", 1, 3), 0), lambda: self.text("div", self.cue("nav", 1, 4), 0, self.attrs("logo brand site-title tagline")), lambda: self.text("h1", self.cue("nav", 1, 3), 0, self.attrs("logo site-title")), lambda: self.text("p", self.cue("nav", 2, 5) if self.family in UNTOLD else self.sentence(), 0))
            return self.wrap(*r.choice([("header", self.attrs("header site-header masthead", 0.4)), ("div", self.attrs("header masthead topbar site-header banner"))]), inner + (self.boilerplate("nav") if r.random() < 0.5 else []))
        if kind == "notice":
            return self.wrap(*r.choice([("div", self.attrs("cookie cookie-banner notice alert gdpr consent popup modal disclaimer overlay")), ("section", self.attrs("notice alert cookie-notice")), ("noscript", "")]), self.text("p", say("notice"), 0) + (self.text("button", self.cue("notice", 1, 2), 0) if r.random() < 0.5 else []))
        if kind == "ad":
            attrs = self.attrs("ad ads advert advertisement sponsored promo banner-ad adsense ad-slot sponsor")
            return some(lambda: [(f"<div{attrs}>{(t := say('ad'))}</div>", t, 0)], lambda: self.wrap("div", attrs, self.text("p", say("ad"), 0)), lambda: self.wrap("aside", attrs, self.text("a", say("ad"), 0)))
        if kind == "side":
            inner = self.text(r.choice(["h2", "h3", "h4"]), self.cue("side", 1, 4), 0)
            inner += self.links("side", 2, 6) if self.family in UNTOLD or r.random() < 0.6 else [x for _ in range(r.randint(1, 3)) for x in self.text("p", self.prose(2), 0)]
            return self.wrap(*r.choice([("aside", self.attrs("sidebar widget", 0.5)), ("div", self.attrs("sidebar side related widget recommended trending popular aside rail")), ("section", self.attrs("related related-posts more-news"))]), inner)
        if kind == "form":
            inner = [x for _ in range(r.randint(1, 3)) for x in self.text("label", self.cue("form", 1, 3), 0)] + [('<input type="text" name="q">', None, 0)] + self.text(r.choice(["button", "p", "legend"]), say("form"), 0)
            form = self.wrap("form", self.attrs("search newsletter login signup", 0.5), inner)
            return form if r.random() < 0.6 else self.wrap("div", self.attrs("newsletter subscribe search-box login"), form)
        if kind == "share":
            return self.wrap("div", self.attrs("share social sharing social-links share-buttons tools"), self.links("share", 2, 5) if r.random() < 0.5 else [x for _ in range(r.randint(2, 4)) for x in self.text(r.choice(["p", "div"]), self.cue("share", 1, 2), 0)])
        if kind == "footer":
            inner = self.text(r.choice(["p", "div", "small"]), "&copy; " * (r.random() < 0.6) + say("footer"), 0)
            return self.wrap(*r.choice([("footer", self.attrs("footer", 0.4)), ("div", self.attrs("footer site-footer bottom copyright legal colophon"))]), inner + (self.links("nav", 2, 5) if r.random() < 0.4 else []) if r.random() < 0.6 else [((t := r.choice(["&copy; ", "&#169; ", "(c) ", "", ""]) + r.choice(["1998-2024 ", "2020 ", ""]) + say("footer")), t, 0)])
        inner = []
        if r.random() < 0.7:
            inner += self.text(r.choice(["h2", "h3"]), self.cue("comments", 1, 3), 0)
        for _ in range(r.randint(1, 6)):
            one = self.text(r.choice(["span", "div", "cite", "h4"]), self.cue("comments", 1, 4), 0, self.attrs("author comment-author meta user", 0.7)) if r.random() < 0.7 else []
            one += [x for _ in range(r.randint(1, 2)) for x in self.text("p", self.prose(4), 0, self.attrs("comment-text comment-body", 0.2))]
            inner += self.wrap(*r.choice([("li", self.attrs("comment", 0.6)), ("div", self.attrs("comment comment-item reply", 0.9)), ("article", self.attrs("comment"))]), one)
        return self.wrap(*r.choice([("section", self.attrs("comments responses discussion")), ("div", self.attrs("comments comment-list discussion responses disqus")), ("ol", self.attrs("comments comment-list commentlist"))]), inner)

    def article(self) -> list:
        r = self.r
        title = self.heading(r.randint(2, 12))
        inner = self.text(r.choice(["h1", "h1", "h1", "h2"]), title, 1, self.attrs("title headline entry-title", 0.3)) if r.random() < 0.9 else []
        if inner and r.random() < 0.2:
            inner = self.wrap("header", self.attrs("entry-header article-header", 0.6), inner)
        if r.random() < 0.2:
            inner += self.text(r.choice(["div", "p"]), self.cue("byline", 2, 6), 0, self.attrs("byline author meta post-meta dateline"))
        short, again = self.sentence(r.randint(1, 3)), r.random() < 0.3
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 14, 60])):
            kind = r.random()
            if again and kind < 0.3:  # articles that say one short thing again and again
                inner += self.text("p", short, 1)
                continue
            if kind < 0.72:
                text = self.prose()
                if r.random() < 0.15 and self.family not in UNTOLD:
                    inner.append((f"<p>{r.choice(['', '<i>', '<b>', '<em>', '<span>'])}{text}{r.choice(['', '<br>', '<br/>'])}", text, 1))  # tags left open
                elif r.random() < 0.15:
                    link = self.word()
                    inner.append((f'<p>{text} <a href="/x">{link}</a> {(tail := self.sentence())}</p>', f"{text} {link} {tail}", 1))
                else:
                    inner += self.text(r.choice(["p", "p", "p", "p", "div"]), text, 1)
            elif kind < 0.80:
                inner += self.text(r.choice(["h2", "h3"]), self.heading(r.randint(1, 7)), 1)
            elif kind < 0.86:
                inner += self.wrap(r.choice(["ul", "ol"]), "", [x for _ in range(r.randint(2, 5)) for x in self.text("li", self.sentence(), 1)])
            elif kind < 0.90:
                inner += self.wrap("blockquote", "", self.text("p", self.prose(2), 1))
            elif kind < 0.93:
                inner += self.wrap("table", "", [y for _ in range(r.randint(1, 3)) for y in self.wrap("tr", "", [x for _ in range(2) for x in self.text("td", self.sentence(r.randint(1, 5)), 1)])])
            elif kind < 0.94:
                inner += self.text("pre", self.prose(2), 1)
            elif kind < 0.96:
                inner += self.wrap("figure", "", [('<img src="a.png" alt="">', None, 0), *self.text("figcaption", self.sentence(r.randint(2, 12)), 1)])
            else:
                inner += self.boilerplate(r.choice(["ad", "share", "side", "form", "notice"]))
        if r.random() < 0.1:
            inner += self.boilerplate("comments")
        if self.family in UNTOLD and r.random() < (0.5 if self.family == "cells" else 0.15):
            inner = self.broken(inner)
        if self.family == "bare" or self.family == "cells" and r.random() < 0.8:
            return inner
        wrappers = [("article", self.attrs("post article story", 0.3)), ("main", self.attrs("main content", 0.3)), ("div", self.attrs("content article post entry entry-content article-body story post-content main-content text body")), ("section", self.attrs("article content story body"))]
        if self.family == "roles":
            wrappers = wrappers[:2]
        out = self.wrap(*r.choice(wrappers), inner)
        return self.wrap("main", self.attrs("main content", 0.5), out) if r.random() < 0.2 else out

    def broken(self, inner: list) -> list:
        """Paragraphs that follow each other become one text with line breaks."""
        out: list = []
        for mark, text, content in inner:
            plain = content and mark.startswith("<p>") and mark.endswith("</p>") and "<a " not in mark
            if plain and out and out[-1][0].endswith("<!---->"):
                before = out.pop()
                out.append((f"{before[0][:-7]}{self.r.choice(['<br>', '<br><br>', '<br/> '])}{text}<!---->", f"{before[1]} {text}", 1))
            elif plain:
                out.append((f"<div></div>{text}<!---->", text, 1))
            else:
                out.append((mark, text, content))
        return out

    def restyled(self, parts: list) -> list:
        """The same texts in the family's tags and names."""
        r, family = self.r, self.family
        if family == "named":
            return parts
        made: dict[str, str] = {}
        paragraph = r.choice(["p", "p", "div"]) if family in UNTOLD else "p"
        title = r.choice(["div", "div", "b"]) if family in UNTOLD and r.random() < 0.65 else ""

        def name(key: str) -> str:
            return made.setdefault(key, "".join(r.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(2, 7))))

        def tag(m: re.Match) -> str:
            close, kind, rest = m[1], m[2], NAMED.sub("", m[3])
            if family == "tags":
                return f"<{close}{kind}{rest}>"
            if kind == "p":
                kind = paragraph
            if title and kind in ("h1", "h2"):
                kind = paragraph if title == "div" else "p"
            if kind in ROLES and (kind != "form" or family == "roles"):
                rest = rest if close or family != "roles" else f'{rest} role="{ROLES[kind]}"'
                kind = kind if kind == "form" else "div"
            if family == "hashed" and not close and kind in ("div", "section", "ul", "ol", "p", "li", "h2", "h3") and (m[2] == "div" or r.random() < 0.5):
                rest += f' class="{name(m[2] + m[3])}"'
            return f"<{close}{kind}{rest}>"

        return [(TAG.sub(tag, mark), text, content) for mark, text, content in parts]

    def cells(self, before: list, article: list, after: list) -> list:
        """Everything in a layout table; menus are rows of cells or stand beside the article."""
        r = self.r
        row = lambda cells: self.wrap("tr", "", [x for c in cells for x in self.wrap("td", r.choice(["", "", ' valign="top"', ' width="20%"']), c)])
        menu = lambda: [[(f'<a href="/{k}">{t}</a>', t, 0)] for k in range(r.randint(2, 7)) for t in [self.cue("nav", 1, 2)]]
        rows = [x for b in before for x in row([b])]
        if r.random() < 0.5:
            rows += row(menu())
        side = [r.choice([lambda: self.boilerplate("nav"), lambda: self.boilerplate("side"), lambda: [x for m in menu() for x in [*m, ("<div></div>", None, 0)]]])()] if r.random() < 0.5 else []
        beside = [article, *side] if r.random() < 0.5 else [*side, article]
        rows += row(beside)
        rows += [x for b in after for x in row([[(TAG.sub(lambda m: "" if m[2] in ("p", "div", "footer", "small") and r.random() < 0.8 else m[0], mark), text, c) for mark, text, c in b] if len([1 for _, t, _ in b if t]) == 1 else b])]
        return self.wrap("table", r.choice(["", ' border="0"', ' width="100%"']), rows)

    def page(self, family: str | None = None) -> tuple[str, list[tuple[str, int]]]:
        """Markup, and the text and label of each block."""
        r = self.r
        self.family = family or r.choices(list(FAMILIES), list(FAMILIES.values()))[0]
        few = 0.5 if self.family == "bare" else 1.0
        before = [k for k in ("notice", "header", "nav", "ad", "form", "share") if r.random() < few * (0.6 if k in ("nav", "header") else 0.3)]
        after = [k for k in ("share", "side", "ad", "comments", "form", "nav", "notice") if r.random() < 0.3 * few] + ["footer"] * (r.random() < 0.85 * few)
        if r.random() < 0.3:
            r.shuffle(before)
        head, tail = [self.boilerplate(k) for k in before], [self.boilerplate(k) for k in after]
        if r.random() < 0.15:
            head.append(self.boilerplate("side"))
        article = self.article()
        parts = self.cells(head, article, tail) if self.family == "cells" else [x for b in head for x in b] + article + [x for b in tail for x in b]
        if r.random() < 0.3 and self.family != "bare":
            parts = self.wrap("div", self.attrs("page wrapper container site"), parts)
        parts = self.restyled(parts)
        title = self.sentence(6)
        links = ["<meta name=viewport content=1>", '<link rel="stylesheet" href="/s.css">', "<style>.x{color:red}</style>", "<script>window.q=['<div>a</div>'];</script>", ""]
        head_mark = f"<html><head><title>{title}</title>{''.join(r.sample(links, r.randint(0, 3)))}</head><body>"
        marks = "".join(m + r.choice(["", "", "\n", "<!-- x -->"]) for m, *_ in parts)
        if self.family in UNTOLD and r.random() < 0.2:  # no head at all
            return marks, [(t, c) for _, t, c in parts if t is not None]
        return r.choice(["<!DOCTYPE html>", "<!doctype html>\n", ""]) + head_mark + marks + "</body></html>" * (r.random() < 0.9), [(title, 0)] + [(t, c) for _, t, c in parts if t is not None]
