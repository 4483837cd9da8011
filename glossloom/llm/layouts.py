"""Training pages for the block labeller: texts of sampled pages set anew in layouts whose labels are known."""

from __future__ import annotations

import html
from collections.abc import Iterable

import numpy as np

from glossloom.llm.blocks import Block, blocks

#: Elements whose text is not the article's, and those that hold it.
APART = frozenset("nav header footer aside form menu select button option dialog fieldset label legend".split())
HOLDING = frozenset(("article", "main"))
#: Names that authors give to parts. They steer training only.
CONTENT = "content main-content post post-content post-body entry entry-content article article-body article__text story story-body text body-text page-content prose markdown-body single hentry article-main body-copy maincol".split()
SIDE = "sidebar side-bar widget widget-area secondary rail right-column related related-posts recommended more-stories trending popular tags tag-cloud categories archive blogroll author-box about-author toc".split()
MENU = "menu nav navbar navigation main-menu top-nav breadcrumb breadcrumbs topbar links toolbar pager pagination skip-link site-nav dropdown".split()
HEAD = "header site-header masthead page-header branding logo top hero-banner site-title tagline".split()
FOOT = "footer site-footer colophon copyright legal bottom foot imprint credits".split()
ADS = "ad ads advert advertisement sponsored sponsor promo promotion banner-ad ad-slot adsbygoogle commercial teaser-ad partner".split()
NOTICE = "cookie cookie-notice cookie-banner consent gdpr notice alert banner popup modal overlay message warning privacy-notice paywall announcement newsletter subscribe signup".split()
COMMENTS = "comments comment-list comment comment-body reply replies discussion responses disqus reader-comments thread user-comments commentlist feedback".split()
SHARE = "share social sharing share-buttons social-links follow meta post-meta toolbar-share".split()
PLAIN = "row col wrap wrapper container inner box grid block section panel c1 c2 module item unit layout page outer left center".split()
PHRASES = {
    "menu": "Home|About|Contact|News|Sports|Business|Products|Services|Blog|Login|Sign in|Register|Help|FAQ|Search|Categories|Next|Previous|Older posts|Newer posts|Page 1 of 9|Skip to content|Menu".split("|"),
    "head": "The Daily Site|My Blog|Welcome to our site|Just another weblog|Your trusted source of news|Company name".split("|"),
    "foot": "© 2024 All rights reserved.|Copyright 2023 Example Inc.|Privacy policy|Terms of use|Powered by Example|Contact us|Imprint|Sitemap|Back to top".split("|"),
    "ads": "Advertisement|Sponsored|Buy now and save 50%!|Click here for a special offer|Best deals of the week|Ad|Limited time offer, order today.|Promoted content".split("|"),
    "notice": "We use cookies to improve your experience. By using this site you agree to our cookie policy.|Accept all|Accept cookies|Reject|This site uses cookies.|Please enable JavaScript.|You are using an outdated browser.|Subscribe to our newsletter|Get the latest news in your inbox.|Sign up to continue reading|Manage preferences".split("|"),
    "comments": "3 comments|Leave a reply|Reply|Log in to comment|Great post, thanks for sharing!|I totally agree with you.|Posted by anna on May 3, 2021 at 10:12|Comments are closed.|John says:|Report abuse|Like".split("|"),
    "share": "Share|Tweet|Share this|Email|Print|Follow us|Like this|Share on Facebook|5 min read|Filed under news".split("|"),
    "side": "Related articles|Recent posts|Popular|Archives|Tags|You may also like|About the author|Read more|Trending now|Most read|In this section".split("|"),
    "form": "Name|Email|Search|Submit|Send|Your message|Password|Remember me|Username|Subscribe|Comment|Enter your email address|Choose a country".split("|"),
}


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks that the page's own elements mark as its article; None for a page without such elements."""
    held = [bool(HOLDING & set(b.path)) for b in page]
    if not any(held):
        return None
    return np.array([h and not APART & set(b.path) for h, b in zip(held, page)], np.float32)


def pools(pages: Iterable[list[Block]]) -> tuple[list[str], list[str]]:
    """(texts of articles, other texts); of pages that mark no article, long texts without links are taken for one."""
    inside, outside = [], []
    for page in pages:
        y = weak_labels(page)
        for i, b in enumerate(page):
            is_text = y[i] if y is not None else len(b.text) >= 100 and b.linked < 0.2 * len(b.text)
            (inside if is_text else outside).append(b.text)
    return inside or ["A first sentence of a text. And a second one, which ends it.", "Short."], outside or ["Home"]


class Layout:
    """One random page with a label for each block."""

    def __init__(self, rng: np.random.Generator, inside: list[str], outside: list[str]):
        self.rng, self.inside, self.outside = rng, inside, outside
        self.parts: list[str] = []
        self.anonymous = rng.random() < 0.2  # names tell nothing on such a page
        self.n = 0

    def one(self, xs):
        return xs[self.rng.integers(len(xs))]

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def named(self, tag: str, names: list[str], always: bool = False) -> str:
        if self.anonymous or (not always and self.odds(0.25)):
            return self.one([f"<{tag}>", f'<{tag} class="{self.one(PLAIN)}">'])
        name = self.one(names)
        extra = f" {self.one(PLAIN)}" if self.odds(0.3) else ""
        return self.one([f'<{tag} class="{name}{extra}">', f'<{tag} id="{name}">', f'<{tag} class="{name}" role="{self.one(PLAIN)}">'])

    def put(self, tag: str, text: str, label: int, link: bool = False) -> None:
        """A block; the token before it tells afterwards which label it has."""
        token = f"qx{self.n}x{label}qx "
        self.n += 1
        body = html.escape(text, quote=False)
        if link:
            body = f'<a href="/{self.n}">{token}{body}</a>'
        else:
            body = token + body
            if label and self.odds(0.15) and " " in text:
                body = f'{body} <a href="/x">{self.one(self.outside)[:20]}</a>'.replace("\n", " ")
        self.parts.append(f"<{tag}>{body}</{tag}>" if tag else f"{body}<br>")

    def any(self) -> str:
        return self.one(self.inside if self.odds(0.5) else self.outside)

    def text(self) -> str:
        """Mostly an article's text; sometimes another, so that a sampled text's words alone tell nothing."""
        if not self.anonymous and self.odds(0.06):
            return self.one(PHRASES[self.one(list(PHRASES))])
        return self.one(self.inside) if self.odds(0.8) else self.any()

    def other(self, kind: str) -> str:
        """A usual phrase, or a few words of any text."""
        if self.odds(0.55):
            return self.one(PHRASES[kind])
        words = self.any().split()
        at = self.rng.integers(len(words))
        return " ".join(words[at : at + self.rng.integers(1, 9)])

    def links(self, kind: str, most: int = 8) -> None:
        if self.odds(0.75):
            self.parts.append("<ul>")
            for _ in range(self.rng.integers(1, most)):
                self.put("li", self.other(kind), 0, link=True)
            self.parts.append("</ul>")
        else:
            for _ in range(self.rng.integers(1, 4)):
                self.put(self.one(["div", "p"]), self.other(kind), 0, link=True)

    def part(self, kind: str, names: list[str], tags: tuple[str, ...], prose: float = 0.0, within: bool = False) -> None:
        """A part of the page that is not its article; inside the article its element or its name tells so."""
        plain = self.one(tags)
        tag = plain if self.odds(0.6) else "div"
        anonymous, self.anonymous = self.anonymous, self.anonymous and not within
        self.parts.append(self.named(tag, names, always=tag in ("div", "section", "ul", "footer")))
        self.anonymous = anonymous
        if self.odds(0.3):
            self.put(self.one(["h2", "h3", "h4"]), self.other(kind), 0)
        for _ in range(self.rng.integers(1, 4)):
            if self.odds(prose):
                self.put("p", self.text() if self.odds(0.6) else self.other(kind), 0)
            elif kind == "form" or self.odds(0.3):
                self.put(self.one(["p", "div"]), self.other(kind), 0)
            else:
                self.links(kind)
        self.parts.append(f"</{tag}>")

    def form(self) -> None:
        self.parts.append(self.named("form", ["search", "login", "contact", "subscribe", "search-form"]))
        for _ in range(self.rng.integers(1, 4)):
            self.put(self.one(["div", "p", "button", "legend"]), self.other("form"), 0)
        self.parts.append("<input name=q></form>")

    def comments(self) -> None:
        tag = self.one(["section", "div", "ol", "ul"])
        anonymous, self.anonymous = self.anonymous, False
        self.parts.append(self.named(tag, COMMENTS, always=True))
        if self.odds(0.7):
            self.put(self.one(["h2", "h3"]), self.other("comments"), 0)
        for _ in range(self.rng.integers(1, 6)):
            inner = "li" if tag in ("ol", "ul") else self.one(["div", "article"])
            self.parts.append(self.named(inner, COMMENTS))
            if self.odds(0.6):
                self.put(self.one(["p", "div", "header"]), self.other("comments"), 0)
            self.put("p", self.text() if self.odds(0.7) else self.other("comments"), 0)
            self.parts.append(f"</{inner}>")
        self.parts.append(f"</{tag}>")
        self.anonymous = anonymous

    def article(self) -> None:
        kind = self.rng.random()
        opened = []
        if kind < 0.35:
            opened.append("article")
            self.parts.append(self.named("article", CONTENT))
        elif kind < 0.5:
            opened.append("main")
            self.parts.append(self.named("main", CONTENT))
        if not opened or self.odds(0.4):
            tag = self.one(["div", "div", "div", "section", "td"])
            if tag == "td":
                opened += ["table", "tr", "td"]
                self.parts.append("<table><tr>" + self.named("td", CONTENT))
            else:
                opened.append(tag)
                self.parts.append(self.named(tag, CONTENT, always=self.odds(0.7)))
        if self.odds(0.85):
            head = self.odds(0.2)
            self.parts.append("<header>" * head)
            self.put(self.one(["h1", "h1", "h2"]), self.text()[:80], 1)
            self.parts.append("</header>" * head)
        for _ in range(self.rng.integers(1, 14)):
            r = self.rng.random()
            if r < 0.72:
                self.put(self.one(["p", "p", "p", "p", "div", ""]), self.text(), 1)
            elif r < 0.78:
                self.put(self.one(["h2", "h3", "h4"]), self.text()[:60], 1)
            elif r < 0.84:
                tag = self.one(["ul", "ol"])
                self.parts.append(f"<{tag}>")
                for _ in range(self.rng.integers(1, 5)):
                    self.put("li", self.text()[:150], 1)
                self.parts.append(f"</{tag}>")
            elif r < 0.88:
                self.parts.append("<blockquote>")
                self.put("p", self.text(), 1)
                self.parts.append("</blockquote>")
            elif r < 0.9:
                self.put("pre", self.text(), 1)
            elif r < 0.92:
                self.parts.append("<table><tr>")
                for _ in range(self.rng.integers(2, 5)):
                    self.put(self.one(["td", "th"]), self.text()[:40], 1)
                self.parts.append("</tr></table>")
            elif r < 0.95:
                self.part("ads", ADS, ("div", "aside", "section"), 0.5, within=True)
            elif r < 0.97:
                self.part("side", SIDE, ("aside", "div"), 0.3, within=True)
            else:
                self.part("notice", NOTICE, ("div", "section"), 0.3, within=True)
        if self.odds(0.2):
            self.part("share", SHARE, ("div", "ul", "footer"), within=True)
        if self.odds(0.15):
            self.comments()
        self.parts += [f"</{t}>" for t in reversed(opened)]

    def page(self) -> tuple[list[Block], np.ndarray]:
        odds = self.odds
        shell = self.one(["", "<div>", '<div id="page">', '<div class="wrapper">', '<div class="container"><div class="row">'])
        self.parts.append(f"<html><head><title>{html.escape(self.text()[:60])}</title></head><body>{shell}")
        if odds(0.3):
            self.part("notice", NOTICE, ("div", "section", "aside"), 0.2)
        if odds(0.5):
            self.part("head", HEAD, ("header", "div"), 0.1)
        if odds(0.7):
            self.part("menu", MENU, ("nav", "div", "ul"))
        if odds(0.15):
            self.form()
        if odds(0.3):
            self.part("ads", ADS, ("div", "aside"), 0.5)
        side_first = odds(0.3)
        if side_first:
            self.part("side", SIDE, ("aside", "div", "section"), 0.35)
        if odds(0.96):
            self.article()
        if odds(0.25):
            self.comments()
        if odds(0.3) and not side_first:
            self.part("side", SIDE, ("aside", "div", "section"), 0.35)
        if odds(0.2):
            self.form()
        if odds(0.15):
            self.part("share", SHARE, ("div", "section"))
        if odds(0.2):
            self.part("ads", ADS, ("div", "aside"), 0.5)
        if odds(0.8):
            self.part("foot", FOOT, ("footer", "div"), 0.2)
        if odds(0.15):
            self.part("notice", NOTICE, ("div", "dialog"), 0.3)
        found, labels = [], []
        for b in blocks("".join(self.parts) + "</body></html>"):
            head, _, rest = b.text.partition("qx ")
            if head.startswith("qx") and rest.strip():
                b.text = rest
                while "qx " in b.text[:40] and b.text.startswith("qx"):
                    b.text = b.text.partition("qx ")[2]
                found.append(b)
                labels.append(float(head[-1] == "1"))
        return found, np.array(labels, np.float32)
