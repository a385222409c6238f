"""Web pages whose main text is known by construction, for fitting html.py's weights.

Each page is put together from parts of known role: an article of blocks (its title,
paragraphs with emphasis and links, lists, tables, quotes, captions), and around it, or
amid it, menus, headers, footers, sidebars, notices, adverts, forms and comments, each in
the markup and under one of the names that sites use for it. Words are invented, so
nothing but markup tells the parts apart. One seed gives the same pages on each run.
"""

from __future__ import annotations

import random

#: Names of classes and ids that sites give to parts of each role.
NAMES = {
    "menu": "nav navbar navigation menu main-menu breadcrumb breadcrumbs pagination pager toolbar toc tabs skip-link".split(),
    "header": "header masthead site-header top-bar logo".split(),
    "footer": "footer site-footer copyright colophon bottom-bar".split(),
    "sidebar": "sidebar side aside widget widgets related related-posts recommended popular trending archive-list tags tag-cloud".split(),
    "notice": "cookie cookies cookie-banner consent gdpr notice alert banner popup modal overlay paywall newsletter subscribe signup".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion outbrain taboola".split(),
    "form": "login search search-form contact-form register".split(),
    "comments": "comments comment comment-list disqus replies reply respond reviews".split(),
    "share": "share sharing social social-links follow-us".split(),
    "body": "content post entry story article-body text main-content body page wrapper container row column section inner outer box".split(),
    "block": "lead intro summary quote caption note first last highlight text paragraph dropcap is hidden here".split(),
}
ELEMENTS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "ins", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul", "span"]}
AMID = ["advert", "share", "sidebar", "notice", "form", "menu", "comments"]


class Maker:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        return " ".join("".join(self.draw.choices("aeiounrstl", k=self.draw.randint(2, 8))) for _ in range(self.draw.randint(least, most)))

    def named(self, role: str, chance: float = 0.7) -> str:
        if self.draw.random() > chance:
            return ""
        return f' {self.draw.choice(["class", "class", "id"])}="{self.draw.choice(NAMES[role])}"'

    def block(self) -> tuple[str, list[str]]:
        """One block of an article, or a few: source, and lines of text."""
        d, a, b, c = self.draw, self.words(8, 60), self.words(1, 3), self.words(5, 30)
        kind = d.choice(["p"] * 8 + ["link", "bold", "list", "linked list", "heading", "quote", "table", "figure", "pre", "div", "terms", "break"])
        name = self.named("block", 0.2)
        if kind == "link":
            return f'<p{name}>{a} <a href="/x">{b}</a> {c}</p>', [f"{a} {b} {c}"]
        if kind == "bold":
            return f"<p{name}>{a} <{(t := d.choice(['b', 'i', 'em', 'strong', 'code', 'span']))}>{b}</{t}> {c}</p>", [f"{a} {b} {c}"]
        if kind in ("list", "linked list"):
            items = [self.words(2, 12) for _ in range(d.randint(2, 6))]
            shown = [f'<a href="/x">{x}</a>' if kind == "linked list" and d.random() < 0.5 else x for x in items]
            t = d.choice(["ul", "ol"])
            return f"<{t}{name}>" + "".join(f"<li>{x}</li>" for x in shown) + f"</{t}>", items
        if kind == "heading":
            t = d.choice(["h2", "h3", "h4"])
            return f"<{t}{name}>{b}</{t}>", [b]
        if kind == "quote":
            return f"<blockquote{name}><p>{a}</p></blockquote>", [a]
        if kind == "table":
            return f"<table{name}><tr><th>{b}</th></tr><tr><td>{c}</td></tr></table>", [b, c]
        if kind == "figure":
            return f"<figure{name}><img src=x><figcaption>{c}</figcaption></figure>", [c]
        if kind == "terms":
            return f"<dl{name}><dt>{b}</dt><dd>{c}</dd></dl>", [b, c]
        if kind == "break":
            return f"<p{name}>{a}<br>{c}</p>", [a, c]
        t = kind if kind in ("pre", "div") else "p"
        return f"<{t}{name}>{a}</{t}>", [a]

    def part(self, role: str) -> str:
        """A part that is no content."""
        d = self.draw
        t = d.choice(ELEMENTS[role])
        name = self.named(role, 0.6 if t in ("nav", "header", "footer", "aside", "form") else 1.0)
        if role in ("menu", "share") or role == "sidebar" and d.random() < 0.6:
            links = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(d.randint(3, 9))]
            inner = "".join(f"<li>{x}</li>" for x in links) if t == "ul" else "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if d.random() < 0.6 else " ".join(links)
        elif role == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=x><button>{self.words(1, 2)}</button><p>{self.words(2, 10)}</p>"
        elif role == "comments":
            inner = "".join((f"<li><p>{x}</p></li>" if t == "ol" else f"<div><p>{x}</p></div>" if d.random() < 0.5 else f"<p>{x}</p>") for x in (self.words(4, 40) for _ in range(d.randint(1, 4))))
        elif role == "header":
            inner = f'<a href="/">{self.words(1, 3)}</a> {self.words(0, 4)}'
        else:
            inner = f"<p>{self.words(3, 30)}</p>" if d.random() < 0.5 else self.words(3, 30)
        return f"<{t}{name}>{inner}</{t}>"

    def page(self) -> tuple[str, str]:
        """A page and its main text."""
        d = self.draw
        title = self.words(3, 9)
        marked = d.random() < 0.5
        head = f"<header><h1>{title}</h1><p>{(by := self.words(2, 5))}</p></header>" if marked and d.random() < 0.3 else f"<h1>{title}</h1>"
        lines = [title] + ([by] if head.startswith("<header") else [])
        body = [head]
        for i in range(d.randint(3, 10)):
            if i and d.random() < 0.2:
                body.append(self.part(d.choice(AMID)))
            source, text = self.block()
            body.append(source)
            lines += text
        if marked and d.random() < 0.5:
            body.append(self.part(d.choice(["comments", "share", "footer", "sidebar"])))
        t = d.choice(["article", "main"]) if marked else d.choice(["div", "div", "section", "td"])
        article = f"<{t}{self.named('body', 0.5)}>" + "".join(body) + f"</{t}>"
        if d.random() < 0.4:
            article = f"<div{self.named('body', 0.8)}>{article}</div>"
        before = [self.part(r) for r in ("header", "menu", "notice", "advert", "form") if d.random() < 0.5]
        after = [self.part(r) for r in ("comments", "sidebar", "share", "advert", "footer") if d.random() < 0.5]
        return f"<html><body{self.named('body', 0.2)}>" + "".join([*before, article, *after]) + "</body></html>", "\n".join(lines)


def pages(count: int = 400, seed: int = 7) -> list[tuple[str, str]]:
    """Pages and their main texts."""
    maker = Maker(seed)
    return [maker.page() for _ in range(count)]
