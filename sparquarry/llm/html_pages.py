"""Generated web pages with known labels, to train the block labeller.

Every text starts with a private-use character that names its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ARTICLE, MENU, HEADER, FOOTER, SIDEBAR, NOTICE, ADVERT, FORM, COMMENT, TITLE = range(10)

#: Letters of made-up languages: consonants and vowels of some scripts.
SCRIPTS = [("bcdfghjklmnpqrstvwxyz", "aeiou"), ("bdfgklmnprstvz", "aeiouyàèéêôùäöüåøãõ"), ("бвгджзклмнпрстфхцчш", "аеиоуыэюя"), ("βγδζθκλμνξπρστφχψ", "αεηιοωυ"), ("漢字文語読書人大小中国日本", "的是了在有我他这")]
SAID = {
    MENU: "home about contact news sport archive products login menu search next previous sitemap".split(),
    HEADER: "welcome menu daily site tagline subscribe sign in".split(),
    FOOTER: "copyright © all rights reserved privacy terms imprint contact 2023 2024 powered by".split(),
    SIDEBAR: "related popular latest posts tags categories recent most read also trending".split(),
    NOTICE: "cookies cookie consent we use accept policy notice subscribers please enable javascript warning privacy settings".split(),
    ADVERT: "sponsored advertisement buy now sale offer discount deal shop free shipping click here".split(),
    FORM: "name email submit send password search subscribe your message newsletter register".split(),
    COMMENT: "reply said wrote comment comments i agree thanks great post user ago likes".split(),
}


CUES = sorted({w for ws in SAID.values() for w in ws})

#: The private-use character of label 0.
FIRST_MARK = 0xE000


def unmark(text: str) -> tuple[int, str]:
    """The label of a block's text, and the text without marks."""
    return ord(text[0]) - FIRST_MARK, "".join(c for c in text if not FIRST_MARK <= ord(c) < FIRST_MARK + 16).strip()


class Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.speak()

    def speak(self) -> None:
        """A language for a page: letters, syllables, and a few short words that return all the time."""
        consonants, vowels = SCRIPTS[int(min(self.rng.geometric(0.45) - 1, len(SCRIPTS) - 1))]
        pick = lambda xs, n: [xs[i] for i in self.rng.integers(len(xs), size=n)]
        self.bare = False
        self.worldly = self.chance(0.5)
        self.dense = consonants[0] == "漢"  # written without spaces
        self.syllables = [c + v + e for c, v, e in zip(pick(consonants, 60), pick(vowels, 60), pick(["", "", *consonants], 60))]
        self.common = [a + b for a, b in zip(pick(self.syllables, 14), pick(["", "", *vowels], 14))]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        if self.worldly and self.chance(0.12):  # the words of menus and footers also stand in prose
            return self.pick(*CUES)
        if self.chance(0.35):
            return self.common[int(self.rng.integers(len(self.common)))]
        return "".join(self.syllables[i] for i in self.rng.integers(len(self.syllables), size=int(self.rng.integers(1, 5))))

    def sentence(self, least: int = 1, most: int = 25) -> str:
        ws = [self.word() for _ in range(int(self.rng.integers(least, most + 1)))]
        ws = [w + "," if self.chance(0.06) else w for w in ws]
        if self.chance(0.05):
            ws = [w.upper() for w in ws]
        if self.chance(0.06):  # numbers, prices, marks
            ws[int(self.rng.integers(len(ws)))] = self.pick("12", "3.5%", "$40", "1998", "(a)", "&amp;", "&mdash;", "x = 2", "https://a.example/b", "|", "***")
        if self.chance(0.05):  # words said over and over
            ws = [w for w in ws[: int(self.rng.integers(1, 7))] for _ in range(int(self.rng.integers(3, 60)))]
        if self.dense:
            return "".join(ws).replace(",", "，") + self.pick("。", "。", "")
        return " ".join(ws).capitalize() + self.pick(".", ".", ".", ".", "!", "?", "", ":")

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(max(1, sentences)))

    def say(self, label: int, words: int) -> str:
        """Text for a label other than article: its usual words or, as often, any words."""
        if self.chance(0.45):
            return " ".join(self.pick(*SAID[label]) if self.chance(0.5) else self.word() for _ in range(max(1, words)))
        return self.prose(max(1, words // 8)) if words > 5 or self.chance(0.3) else " ".join(self.word() for _ in range(max(1, words)))

    @staticmethod
    def mark(label: int, text: str) -> str:
        return chr(FIRST_MARK + label) + text

    def attr(self, *options: str) -> str:
        """A class or id, now and then none."""
        if self.chance(0.12):
            return ""
        return f' {self.pick("class", "class", "id")}="{self.pick(*options)}"'

    def token(self) -> str:
        """A class that says nothing."""
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"
        made = "".join(letters[i] for i in self.rng.integers(len(letters), size=int(self.rng.integers(2, 8))))
        return self.pick("x", "css-", "sc-", "b", "col-md-", "l-", "u-", "js-", "") + made

    def plain(self) -> str:
        """Attributes that say nothing, or none."""
        return self.pick("", f' class="{self.token()}"', f" class={self.token()}", f' class="{self.token()} {self.token()}"', f' id="{self.token()}"', f' style="margin:0" data-x="{self.token()}"')

    def wrap(self, inner: str, most: int = 3) -> str:
        for _ in range(int(self.rng.integers(0, most + 1))):
            kind = self.pick("", "container", "wrapper", "row", "inner", "site", "page", "layout", "grid", "col", "section")
            inner = f"<div{self.plain() if self.chance(0.5) or not kind else f' class={chr(34)}{kind} {self.token()}{chr(34)}'}>{inner}</div>"
        return inner

    def links(self, label: int, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.mark(label, self.say(label, int(self.rng.integers(1, 4))))}</a>'
        style = self.pick("ul", "ul", "div", "p")
        if style == "ul":
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<{style}>{item()}</{style}>" for _ in range(n))

    def menu(self) -> str:
        n = int(self.rng.integers(1, 9))
        if self.chance(0.7):
            return f"<nav{self.attr('menu', 'main-nav', 'navbar', 'breadcrumb') if self.chance(0.4) else ''}>{self.links(MENU, n)}</nav>"
        return f"<div class=\"{self.pick('menu', 'nav', 'navigation', 'breadcrumbs', 'main-menu', 'navbar', 'pagination')}\">{self.links(MENU, n)}</div>"

    def header(self) -> str:
        inner = "".join(f"<{t}>{self.mark(HEADER, self.say(HEADER, int(self.rng.integers(1, 7))))}</{t}>" for t in self.pick(("div",), ("p",), ("h1", "p"), ("h2",), ("span",)))
        if self.chance(0.4):
            inner += self.menu()
        return f"<header{self.attr('site-header', 'top', 'masthead') if self.chance(0.5) else ''}>{inner}</header>" if self.chance(0.7) else f"<div class=\"{self.pick('header', 'site-header', 'masthead', 'banner top', 'page-header')}\">{inner}</div>"

    def footer(self) -> str:
        inner = f"&copy; {self.mark(FOOTER, self.say(FOOTER, int(self.rng.integers(2, 20))))}"
        inner = self.mark(FOOTER, f"&copy; {self.word()}.example &middot; {self.say(FOOTER, int(self.rng.integers(2, 20)))}") if self.chance(0.6) else f"<p>{self.mark(FOOTER, inner[7:] if self.chance(0.5) else self.say(FOOTER, 8))}</p>"
        if self.chance(0.3):
            inner += self.links(FOOTER, int(self.rng.integers(1, 5)))
        if self.chance(0.75):
            return f"<footer{self.attr('site-footer', 'bottom') if self.chance(0.4) else ''}>{inner}</footer>"
        return f"<div class=\"{self.pick('footer', 'site-footer', 'page-footer', 'copyright', 'bottom-bar footer')}\">{inner}</div>"

    def sidebar(self) -> str:
        inner = f"<{(t := self.pick('h2', 'h3', 'h4'))}>{self.mark(SIDEBAR, self.say(SIDEBAR, 2))}</{t}>" + (self.links(SIDEBAR, int(self.rng.integers(1, 7))) if self.chance(0.7) else f"<p>{self.mark(SIDEBAR, self.say(SIDEBAR, int(self.rng.integers(5, 30))))}</p>")
        if self.chance(0.6):
            return f"<aside{self.attr('sidebar', 'related', 'widget') if self.chance(0.6) else ''}>{inner}</aside>"
        return f"<div class=\"{self.pick('sidebar', 'related', 'related-posts', 'widget', 'widget-area secondary', 'side', 'rail', 'share', 'social-share', 'tags', 'author-bio', 'recommended', 'read-more', 'most-read', 'infobox', 'navbox')}\">{inner}</div>"

    def notice(self) -> str:
        inner = self.mark(NOTICE, self.say(NOTICE, int(self.rng.integers(4, 30))))
        inner = f"<p>{inner}</p>" if self.chance(0.5) else inner
        if self.chance(0.4):
            inner += f"<button>{self.mark(NOTICE, self.say(NOTICE, 1))}</button>"
        return f"<{(t := self.pick('div', 'div', 'section', 'aside'))} {self.pick('class', 'id')}=\"{self.pick('cookie', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'site-notice', 'cookie-consent', 'banner', 'popup', 'modal', 'paywall', 'newsletter')}\">{inner}</{t}>"

    def advert(self) -> str:
        inner = self.mark(ADVERT, self.say(ADVERT, int(self.rng.integers(2, 25))))
        inner = self.pick(inner, inner, f"<p>{inner}</p>", f'<a href="#">{inner}</a>')
        return f"<{(t := self.pick('div', 'div', 'div', 'aside', 'section'))} {self.pick('class', 'class', 'class', 'id')}=\"{self.pick('ad', 'ad', 'ads', 'advert', 'advertisement', 'ad-banner', 'sponsored', 'promo', 'adsense', 'sponsor', 'ad-slot')}\">{inner}</{t}>"

    def form(self) -> str:
        inner = "".join(self.pick(f"<label>{self.mark(FORM, self.say(FORM, 2))}</label><input name=x>", f"<p>{self.mark(FORM, self.say(FORM, 4))}</p>", f"<button>{self.mark(FORM, self.say(FORM, 1))}</button>", f"<div>{self.mark(FORM, self.say(FORM, 3))}</div>", f"<select><option>{self.mark(FORM, self.word())}<option>{self.mark(FORM, self.word())}</select>") for _ in range(int(self.rng.integers(1, 4))))
        return f"<form{self.attr('search', 'newsletter', 'signup', 'login')}>{inner}</form>"

    def comments(self) -> str:
        def one() -> str:
            body = self.mark(COMMENT, self.say(COMMENT, int(self.rng.integers(2, 40))))
            body = self.pick(f"<p>{body}</p>", body, f"<div class=\"comment-body\"><p>{body}</p></div>")
            who = f"<{(t := self.pick('h4', 'span', 'div', 'b'))} class=\"author\">{self.mark(COMMENT, self.word())}</{t}>" if self.chance(0.5) else ""
            return f"<{(t := self.pick('div', 'li', 'article', 'section'))} class=\"{self.pick('comment', 'comment-item', 'reply', 'comment depth-1', 'user-comment')}\">{who}{body}</{t}>"

        head = f"<{(t := self.pick('h2', 'h3'))}>{self.mark(COMMENT, self.say(COMMENT, 2))}</{t}>" if self.chance(0.6) else ""
        return f"<{(t := self.pick('section', 'div', 'div', 'ol'))} {self.pick('class', 'id')}=\"{self.pick('comments', 'comment-list', 'comments-area', 'discussion', 'responses', 'disqus', 'reader-comments')}\">{head}{''.join(one() for _ in range(int(self.rng.integers(1, 6))))}</{t}>"

    def paragraph(self) -> str:
        n = int(self.rng.integers(1, 9)) if self.chance(0.75) else 1
        text = self.prose(n) if self.chance(0.85) else self.sentence(1, 3)
        if self.chance(0.25):
            ws = text.split(" ")
            at = int(self.rng.integers(len(ws)))
            ws[at] = self.pick(f"<b>{ws[at]}</b>", f'<a href="/x">{ws[at]}</a>', f"<em>{ws[at]}</em>", f"<br>{ws[at]}", f"<span>{ws[at]}</span>")
            text = " ".join(ws)
        text = self.mark(ARTICLE, text)
        style = self.rng.random()
        if self.chance(0.5 if self.bare else 0.08):  # prose without stops
            text = text[0] + "".join(c for c in text[1:] if c not in ".,!?;:")
        if self.loose:  # paragraphs as elements without meaning, or runs between line breaks
            return f"<div{self.plain()}>{text}</div>"
        if style < 0.62:
            return f"<p{self.plain() if self.chance(0.15) else ''}>{text}</p>"
        if style < 0.66:
            return f"<p>{text}"
        if style < 0.70:
            return self.pick(f"<blockquote><p>{text}</p></blockquote>", f"<blockquote>{text}</blockquote>", f"<div{self.plain()}><p>{text}</p></div>", f"<section{self.plain()}><p>{text}</p></section>")
        if style < 0.80:
            return f"<h{(d := self.pick(2, 2, 3, 4))}{self.plain() if self.chance(0.2) else ''}>{self.mark(ARTICLE, self.sentence(1, 8).rstrip('.'))}</h{d}><p>{text}</p>"
        if style < 0.88:
            t = self.pick("ul", "ol")
            return f"<{t}{self.plain() if self.chance(0.2) else ''}>" + "".join(f"<li>{self.mark(ARTICLE, self.sentence(1, 14))}{self.nested(t)}</li>" for _ in range(int(self.rng.integers(1, 6)))) + f"</{t}>"
        if style < 0.93:
            return f"<table{self.plain()}>" + "".join(f"<tr><td>{self.mark(ARTICLE, self.sentence(1, 4))}<td>{self.mark(ARTICLE, self.word())}</tr>" for _ in range(int(self.rng.integers(1, 5)))) + "</table>"
        if style < 0.96:
            return f"<figure{self.plain()}><img src=x>" + f"<figcaption>{self.mark(ARTICLE, self.sentence(2, 14))}</figcaption></figure><p>{text}</p>"
        if style < 0.98:
            return "<dl>" + "".join(f"<dt>{self.mark(ARTICLE, self.word())}</dt><dd>{self.mark(ARTICLE, self.sentence(2, 12))}</dd>" for _ in range(int(self.rng.integers(1, 4)))) + "</dl>"
        return self.pick(f"<pre>{text}</pre>", f"<pre><code>{text}</code></pre>")

    def nested(self, t: str) -> str:
        if not self.chance(0.08):
            return ""
        return f"<{t}>" + "".join(f"<li>{self.mark(ARTICLE, self.sentence(1, 8))}</li>" for _ in range(int(self.rng.integers(1, 4)))) + f"</{t}>"

    def contents(self) -> str:
        """A page's own list of contents."""
        head = f"<{(t := self.pick('h2', 'p', 'div', 'span'))}>{self.mark(MENU, self.pick('Contents', 'Table of contents', 'On this page', 'In this article', self.word()))}</{t}>"
        items = "".join(f"<li><a href='#{self.token()}'>{self.mark(MENU, self.pick('', '1 ', '2.1 ') + self.sentence(1, 4).rstrip('.'))}</a></li>" for _ in range(int(self.rng.integers(1, 7))))
        return f"<{(t := self.pick('div', 'nav', 'div'))} {self.pick('class', 'id')}=\"{self.pick('toc', 'table-of-contents', 'toc contents', 'contents', 'on-this-page')}\">{head}<ul>{items}</ul></{t}>"

    def meta(self) -> str:
        """Who wrote it, labels, ways to share: no part of the text."""
        kind = self.pick("entry-meta", "post-meta", "byline meta", "tags-links", "share-buttons", "social share", "post-tags", "author-box", "entry-footer", "breadcrumbs")
        label = MENU if kind == "breadcrumbs" else SIDEBAR
        return f"<{(t := self.pick('div', 'p', 'ul', 'footer' if 'footer' in kind else 'div'))} class=\"{kind}\">" + "".join(f"<{(u := 'li' if t == 'ul' else 'span')}>{self.pick('', '<a href=/x>')}{self.mark(label, self.say(label, int(self.rng.integers(1, 4))))}</{u}>" for _ in range(int(self.rng.integers(1, 4)))) + f"</{t}>"

    def article(self) -> str:
        self.loose = self.chance(0.15)
        title = self.mark(ARTICLE, self.sentence(1, 12).rstrip("."))
        title = self.pick(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f'<h1 class="{self.pick("entry-title", "post-title", "title", "headline", "page-title", "firstHeading")}">{title}</h1>', f'<h1 itemprop="headline"{self.plain()}>{title}</h1>', f"<h2>{title}</h2>") if self.chance(0.88) else ""
        if title and self.chance(0.3):
            kind = self.pick(' class="entry-header"', ' class="post-header"', ' class="article-header"', "", ' class="page-header"')
            title = f"<header{kind}>{title}{self.meta() if self.chance(0.4) else ''}</header>"
        elif self.chance(0.2):
            title += self.meta()
        parts = [self.paragraph() for _ in range(int(self.rng.integers(1, 16)) if self.chance(0.95) else 0)]
        if self.chance(0.12):
            parts.insert(min(len(parts), self.pick(0, 1)), self.contents())
        for extra, p in ((self.advert, 0.18), (self.sidebar, 0.12), (self.notice, 0.06), (self.form, 0.06)):
            if self.chance(p):
                parts.insert(int(self.rng.integers(len(parts) + 1)), extra())
        body = "".join(parts)
        style = self.rng.random()
        named = self.pick("content", "main", "post", "article", "article-body", "entry-content", "post-content", "story-body", "text", "main-content", "body-text", "post-body entry", "markdown-body", "mw-parser-output", "content-area")
        if self.chance(0.45):
            body = self.wrap(f'<div {self.pick("class", "class", "id")}="{named}{self.pick("", " " + self.token())}">{body}</div>', 1)
        tail = (self.meta() if self.chance(0.2) else "") + (self.comments() if self.chance(0.12) else "")
        inner = title + body + tail
        if style < 0.35:
            kinds = self.pick("", "", ' class="post"', ' class="entry story"', f' id="post-{self.rng.integers(1000)}" class="post type-post status-publish format-standard hentry category-{self.token()}"', self.plain())
            inner = f"<article{kinds}>{inner}</article>"
            return self.wrap(f"<main{self.pick('', self.plain(), ' id=main class=site-main role=main')}>{inner}</main>" if self.chance(0.4) else inner)
        if style < 0.50:
            return self.wrap(f"<main{self.pick('', '', ' role=main', self.plain())}>{inner}</main>")
        if style < 0.75:
            return self.wrap(f'<{(t := self.pick("div", "div", "section"))} {self.pick("class", "id")}="{named}">{inner}</{t}>')
        return self.wrap(f"<div{self.plain()}>{inner}</div>", 4) if self.chance(0.8) else inner

    def page(self) -> str:
        self.speak()
        self.bare = self.chance(0.1)
        before = [p() for p, c in ((self.notice, 0.15), (self.header, 0.45), (self.menu, 0.7), (self.advert, 0.35), (self.form, 0.15), (self.sidebar, 0.15)) if self.chance(c)]
        after = [p() for p, c in ((self.advert, 0.2), (self.comments, 0.35), (self.sidebar, 0.35), (self.form, 0.15), (self.menu, 0.1), (self.footer, 0.8), (self.notice, 0.12)) if self.chance(c)]
        if self.bare:
            before, after = [], []
        if self.chance(0.3):
            before = [before[i] for i in self.rng.permutation(len(before))]
        if self.chance(0.1):  # columns of a table
            cell = lambda x: f"<td{self.pick('', ' valign=top', ' width=160', self.plain())}>{x}</td>"
            body = "".join(before[:-1]) + f"<table{self.pick('', ' width=100%', ' border=0 cellpadding=4')}><tr>{cell(before[-1]) if before else ''}{cell(self.article())}{cell(after[0]) if len(after) > 1 else ''}</tr></table>" + "".join(after[1:] if len(after) > 1 else after)
        else:
            body = "".join(before) + self.article() + "".join(after)
        body = self.wrap(body)
        page = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body{self.pick('', '', self.plain(), ' class=' + chr(34) + 'home page-template single' + chr(34))}>{body}</body></html>"
        return page[: int(len(page) * self.rng.uniform(0.6, 1))] if self.chance(0.12) else page


def generate(n: int, seed: int) -> Iterator[str]:
    maker = Maker(np.random.default_rng(seed))
    for _ in range(n):
        yield maker.page()
