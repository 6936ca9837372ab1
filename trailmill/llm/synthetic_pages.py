"""Generated web pages whose main text is known, to fit and to test the extractor.

Content is spelled with the letters a to m and everything else with n to z, so that every run of text carries its
label; no feature of the extractor looks at letters.
"""

from __future__ import annotations

import numpy as np

_CONTENT, _OTHER = list("abcdefghijklm"), list("nopqrstuvwxyz")
# Class and id names in use for parts of pages.
_PARTS = {
    "menu": ("nav", "main-menu", "navbar", "site-navigation", "breadcrumbs", "top-nav", "menu", "pagination", "toc", "skip-links"),
    "header": ("header", "site-header", "masthead", "page-head", "top-bar", "branding", "banner"),
    "footer": ("footer", "site-footer", "bottom", "colophon", "page-footer", "copyright", "legal"),
    "side": ("sidebar", "side-column", "widget-area", "related-posts", "recommended", "rail", "popular", "secondary", "more-stories", "trending"),
    "ad": ("ad", "ads", "advert", "ad-slot", "banner-ad", "sponsored", "promo", "advertisement", "ad-container"),
    "notice": ("cookie-notice", "cookie-banner", "consent", "alert", "newsletter", "popup", "gdpr", "notice", "modal", "paywall"),
    "form": ("search", "search-form", "login-form", "signup", "contact-form", "subscribe-form", "poll"),
    "talk": ("comments", "comment-list", "discussion", "replies", "reader-comments", "responses", "comment-section", "disqus_thread"),
    "share": ("share", "social-links", "share-buttons", "tags", "post-meta", "byline"),
    "body": ("article", "post", "entry-content", "article-body", "story", "content", "main-content", "post-body", "text", "blog-post"),
}


class _Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def one(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self, letters) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), int(self.rng.integers(1, 9))))

    def words(self, n: int, letters) -> list[str]:
        return [self.word(letters) for _ in range(n)]

    def sentence(self, letters, low: int = 4, high: int = 22) -> str:
        w = self.words(int(self.rng.integers(low, high)), letters)
        if self.chance(0.4):
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + self.one(["."] * 8 + ["?", "!", ""])

    def prose(self, letters, low: int, high: int) -> str:
        return " ".join(self.sentence(letters) for _ in range(int(self.rng.integers(low, high))))

    def attrs(self, part: str, known: float = 0.75) -> str:
        if not self.chance(known):
            return self.one(["", "", f' class="{self.word(_OTHER)}{int(self.rng.integers(99))}"', f' id="c{int(self.rng.integers(999))}"'])
        name = self.one(_PARTS[part])
        return self.one([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word(_OTHER)}"', f" class='box {name}'"])

    def wrap(self, tag: str, attrs: str, inner: str) -> str:
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        items = [f'<{tag}><a href="/{self.word(_OTHER)}">{" ".join(self.words(int(self.rng.integers(1, 7)), _OTHER))}</a></{tag}>' for _ in range(n)]
        return "<ul>" + "".join(items) + "</ul>" if tag == "li" else "".join(items)

    def menu(self) -> str:
        tag, attrs = self.one([("nav", ""), ("nav", self.attrs("menu")), ("div", self.attrs("menu", 0.9)), ("ul", self.attrs("menu", 0.9))])
        if tag == "ul":
            return self.wrap("ul", attrs, "".join(f'<li><a href="/x">{" ".join(self.words(2, _OTHER))}</a></li>' for _ in range(int(self.rng.integers(2, 12)))))
        return self.wrap(tag, attrs, self.links(int(self.rng.integers(1, 14)), self.one(["li", "li", "span", "div"])))

    def header(self) -> str:
        inner = self.one([f"<h1>{' '.join(self.words(3, _OTHER))}</h1>", f'<a href="/">{self.word(_OTHER)}</a>', f"<div>{' '.join(self.words(2, _OTHER))}</div><p>{self.sentence(_OTHER)}</p>", ""])
        tag, attrs = self.one([("header", ""), ("header", self.attrs("header")), ("div", self.attrs("header", 1.0))])
        return self.wrap(tag, attrs, inner + (self.menu() if self.chance(0.6) else ""))

    def footer(self) -> str:
        inner = f"&copy; {self.word(_OTHER)}.example &middot; {self.prose(_OTHER, 1, 4)}"
        inner = self.one([inner, f"<p>{inner}</p>", f"<div>{inner}</div>" + self.links(4), inner + self.menu()])
        tag, attrs = self.one([("footer", ""), ("footer", self.attrs("footer")), ("div", self.attrs("footer", 1.0))])
        return self.wrap(tag, attrs, inner)

    def side(self) -> str:
        inner = "".join(self.one([lambda: f"<h3>{' '.join(self.words(2, _OTHER))}</h3>" + self.links(int(self.rng.integers(2, 9))), lambda: f"<p>{self.prose(_OTHER, 1, 4)}</p>", lambda: self.wrap("div", self.attrs("side"), f"<h4>{self.word(_OTHER)}</h4><p>{self.sentence(_OTHER)}</p>")])() for _ in range(int(self.rng.integers(1, 4))))
        tag, attrs = self.one([("aside", ""), ("aside", self.attrs("side")), ("div", self.attrs("side", 1.0)), ("section", self.attrs("side", 1.0))])
        return self.wrap(tag, attrs, inner)

    def ad(self) -> str:
        text = self.prose(_OTHER, 1, 4)
        inner = self.one([text, f"<p>{text}</p>", f'<a href="http://x.example">{text}</a>', f"<span>{text}</span>"])
        return self.wrap(self.one(["div", "div", "section", "aside", "ins"]), self.attrs("ad", 1.0), inner)

    def notice(self) -> str:
        inner = self.one([self.prose(_OTHER, 1, 5), f"<p>{self.prose(_OTHER, 1, 5)}</p>"]) + self.one(["", f"<button>{self.word(_OTHER)}</button>", f'<a href="#">{self.word(_OTHER)}</a>'])
        return self.wrap(self.one(["div", "div", "section", "aside", "dialog"]), self.attrs("notice", 1.0) + self.one(["", ' role="alert"']), inner)

    def form(self) -> str:
        fields = "".join(f'<label>{" ".join(self.words(2, _OTHER))}</label><input name="q">' for _ in range(int(self.rng.integers(1, 5))))
        form = self.wrap("form", self.one(["", self.attrs("form")]), self.one(["", f"<p>{self.sentence(_OTHER)}</p>", f"<h3>{self.word(_OTHER)}</h3>"]) + fields + f"<button>{self.word(_OTHER)}</button>")
        return form if self.chance(0.6) else self.wrap("div", self.attrs("form"), form)

    def talk(self) -> str:
        one = lambda: self.one(["<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>', "<div>{}</div>"]).format(self.one([f"<b>{self.word(_OTHER)}</b>", f'<span class="author">{self.word(_OTHER)}</span>', ""]) + f"<p>{self.prose(_OTHER, 1, 6)}</p>")
        inner = self.one(["", f"<h2>{' '.join(self.words(2, _OTHER))}</h2>", f"<h3>{self.word(_OTHER)}</h3>"]) + "".join(one() for _ in range(int(self.rng.integers(1, 9))))
        tag = self.one(["div", "section", "ol", "div"])
        return self.wrap(tag, self.attrs("talk", 1.0), inner + (self.form() if self.chance(0.3) else ""))

    def share(self) -> str:
        return self.wrap(self.one(["div", "ul", "p"]), self.attrs("share", 1.0), "".join(f'<a href="#">{self.word(_OTHER)}</a> ' for _ in range(int(self.rng.integers(2, 6)))))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for k in range(len(words)):
            if self.chance(0.04):
                tag = self.one(["b", "em", "a href='/x'", "span", "strong", "i", "code"])
                words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    def content(self) -> str:
        letters = _CONTENT
        p = lambda: self.inline(self.prose(letters, 1, 9))
        kind = self.rng.random()
        if kind < 0.62:
            return self.one([f"<p>{p()}</p>", f"<p>{p()}</p>", f"<p>{p()}", f"<p><b>{p()}<br><p>{p()}</p>", f"<p>{self.sentence(letters, 1, 5)}</p>"])
        if kind < 0.72:
            return f"<h2>{' '.join(self.words(int(self.rng.integers(1, 9)), letters))}</h2>"
        if kind < 0.80:
            tag = self.one(["ul", "ol"])
            return self.wrap(tag, "", "".join(f"<li>{self.sentence(letters)}</li>" for _ in range(int(self.rng.integers(2, 8)))))
        if kind < 0.85:
            return f"<blockquote><p>{p()}</p></blockquote>"
        if kind < 0.89:
            return "<table>" + "".join(f"<tr><td>{' '.join(self.words(2, letters))}</td><td>{self.word(letters)}</td></tr>" for _ in range(4)) + "</table>"
        if kind < 0.93:
            return f'<figure><img src="a.png"><figcaption>{self.sentence(letters)}</figcaption></figure>'
        if kind < 0.96:
            return f"<pre>{self.sentence(letters)}</pre>"
        return f"<div>{p()}</div>"

    def article(self) -> str:
        parts = []
        title = f"<h1>{' '.join(self.words(int(self.rng.integers(2, 12)), _CONTENT))}</h1>"
        if self.chance(0.85):
            parts.append(self.one([title, title, title, f"<header>{title}</header>"]))
        if self.chance(0.15):
            parts.append(self.share())
        for _ in range(int(self.one([1, 1, 2, 2, 3, 4, 6, 8, 10, 14, 18]))):
            parts.append(self.content())
            if self.chance(0.06):
                parts.append(self.one([self.ad, self.notice, self.form, self.side, self.share])())
        tail = [f() for f, q in ((self.share, 0.12), (self.side, 0.08), (self.talk, 0.10)) if self.chance(q)]
        inner = "".join(parts)
        shape = self.rng.random()
        if shape < 0.4:
            return f"<article{self.one(['', '', self.attrs('body')])}>{inner}{''.join(tail)}</article>"
        if shape < 0.55:
            return f"<main><article>{inner}</article>{''.join(tail)}</main>"
        if shape < 0.65:
            return f"<main{self.one(['', self.attrs('body')])}>{inner}{''.join(tail)}</main>"
        if shape < 0.85:
            return f"<div{self.attrs('body')}>{inner}{''.join(tail)}</div>"
        if shape < 0.93:
            return f"<section><div{self.attrs('body')}>{inner}</div>{''.join(tail)}</section>"
        return f"<div><div{self.attrs('body', 0.4)}>{inner}</div></div>{''.join(tail)}"


def is_content(text: str) -> bool:
    low = text.lower()
    return sum("a" <= c <= "m" for c in low) > sum("n" <= c <= "z" for c in low)


def labelled_page(rng: np.random.Generator) -> str:
    """A page; ``is_content`` tells the label of each run of its text."""
    w = _Writer(rng)
    before = [f() for f, p in ((w.notice, 0.3), (w.header, 0.6), (w.menu, 0.6), (w.ad, 0.4), (w.form, 0.15), (w.side, 0.2)) if w.chance(p)]
    after = [f() for f, p in ((w.side, 0.35), (w.talk, 0.4), (w.ad, 0.25), (w.form, 0.15), (w.notice, 0.2), (w.menu, 0.15), (w.footer, 0.85)) if w.chance(p)]
    article = w.article()
    body = "".join(before) + article
    if w.chance(0.25):
        body = f'<div class="{w.one(("wrapper", "container", "page", "layout"))}">{body}'
        after.append("</div>")
    elif w.chance(0.1):
        body = f"<div><div>{body}</div>"
        after.append("</div>")
    head = f'<meta charset="utf-8"><title>{" ".join(w.words(4, _OTHER))}</title><style>p{{margin:0}}</style><script>var t="</p>";</script>'
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}<!-- n -->{''.join(after)}{w.one(['</body></html>', ''])}"
