"""Pages of our own making with labelled blocks, and the training of the block labeller on them.

    python -m quarry.llm.html_train [pages] [epochs]

Pages mix layouts: with and without semantic elements, with boilerplate inside and outside
the article, with names from lists of usual class names, in random words, so that the
labeller has to go by structure and by a page's context. Some are cut off in the middle.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from quarry.llm import html as H

HIDDEN = 20
#: Usual names of page parts.
NAMES = {
    "nav": "nav navbar navigation menu main-menu top-nav breadcrumb breadcrumbs site-nav nav-links pagination pager toc tabs",
    "header": "header site-header masthead top-bar page-header banner branding logo-bar",
    "footer": "footer site-footer page-footer colophon bottom copyright legal footer-links",
    "sidebar": "sidebar side widget widget-area related related-posts recommended right-rail secondary popular trending more-stories aside",
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal disclaimer warning overlay paywall toast",
    "ad": "ad ads advert advertisement sponsored ad-slot promo banner-ad sponsor promotion adbox",
    "form": "form newsletter subscribe signup login search search-box contact-form newsletter-signup subscription",
    "comments": "comments comment-list reader-comments discussion comment replies responses disqus feedback comment-section",
    "share": "share social share-buttons social-links toolbar tags meta byline print-tools",
    "content": "content main-content article-body post-content entry-content story body-text article post entry story-body text main page-content prose",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
#: Usual words of page parts.
SAYINGS = {
    "nav": "Home|About us|Contact|News|Sports|Products|Blog|Help|Archive|Next|Previous|Startseite|Accueil|Inicio|Kontakt",
    "footer": "All rights reserved|Privacy policy|Terms of use|Imprint|Copyright 2021|Powered by|Impressum|Datenschutz|Mentions légales|Aviso legal|Sitemap",
    "notice": "We use cookies to improve this site|Accept all|This site uses cookies|Please enable JavaScript|By continuing you agree to our terms|You have 3 free articles left|Wir verwenden Cookies",
    "ad": "Advertisement|Sponsored|Buy now and save|Limited offer|Anzeige|Publicité|Shop today",
    "form": "Subscribe to our newsletter|Your email|Sign up|Log in|Search|Password|Send|Submit|Enter your name",
    "comments": "Reply|says:|Leave a comment|3 comments|Great post|Report|Like|posted on|wrote:",
    "share": "Share|Tweet|Print|Email this|Tags:|Follow us",
    "sidebar": "Related articles|Most read|You may also like|Popular|Trending|Recent posts|Read more",
    "header": "Welcome|Log in|Daily News|Menu|Search|My account",
}
SAYINGS = {k: v.split("|") for k, v in SAYINGS.items()}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choices("bcdfghjklmnprstvwzaeiouéüñ", k=self.r.randint(1, 4))) for _ in range(120)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3))))

    def prose(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        words, out = [self.word() for _ in range(n)], []
        for k, w in enumerate(words):
            w = w.capitalize() if k == 0 or out[-1][-1] == "." else w
            out.append(w + (self.r.choice(".,,.") if self.r.random() < 0.12 else ""))
        junk = self.r.choice(("", "", "", "", "", "", "###", "&amp;&amp;", "%%%", " |"))
        return (junk + " ").join(out) + self.r.choice((".", ".", ".", "!", "?", ""))

    def named(self, kind: str, tags: tuple[str, ...]) -> tuple[str, str]:
        tag, r = self.r.choice(tags), self.r.random()
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.15:
            name += "-" + self.word()
        if self.r.random() < 0.1:
            name = name.replace("-", "_")
        attributes = f' class="{name}"' if r < 0.5 else f' id="{name}"' if r < 0.75 else f" class='{self.word()} {name}'" if r < 0.85 else ""
        if tag == "div" and not attributes:
            attributes = f' class="{name}"'
        return f"<{tag}{attributes}>", f"</{tag}>"

    def say(self, kind: str) -> str:
        return self.r.choice(SAYINGS[kind]) if self.r.random() < 0.5 else self.prose(1, self.r.choice((4, 12, 30)))

    def links(self, kind: str) -> str:
        items = [f'<a href="/{self.word()}">{self.say(kind) if self.r.random() < 0.6 else self.word()}</a>' for _ in range(self.r.randint(2, 9))]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if style < 0.5 else "") for x in items) + "</ul>"
        return self.r.choice((" ", " | ", "")).join(items) if style < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def boiler(self, kind: str) -> str:
        r = self.r
        tags = {"nav": ("nav", "nav", "div", "ul", "section"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "footer", "div"), "sidebar": ("aside", "aside", "div", "section"), "notice": ("div", "div", "section", "dialog", "aside"), "ad": ("div", "div", "aside", "ins"), "form": ("form", "form", "form", "div"), "comments": ("section", "section", "div", "ol"), "share": ("div", "ul")}[kind]
        a, b = self.named(kind, tags)
        plain = a.startswith(("<section>", "<ul>", "<ol>", "<dialog>", "<ins>"))
        if plain:
            a = a[:-1] + f' class="{r.choice(NAMES[kind])}">'
        if kind in ("nav", "share"):
            inner = self.links(kind)
        elif kind == "header":
            inner = (f"<h1>{self.prose(1, 4)}</h1>" if r.random() < 0.3 else f'<a href="/">{self.prose(1, 3)}</a>') + (self.boiler("nav") if r.random() < 0.4 else f"<p>{self.say(kind)}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = (f"&copy; {self.word()}.example.com &middot; " if r.random() < 0.6 else "") + (self.prose(3, 25) if r.random() < 0.6 else f"<p>{self.say(kind)}</p>" + self.links("footer"))
        elif kind == "sidebar":
            inner = f"<h3>{self.say(kind)}</h3>" + (self.links(kind) if r.random() < 0.5 else "".join(f"<p>{self.prose(4, 40)}</p>" for _ in range(r.randint(1, 3))))
        elif kind == "form":
            inner = f"<label>{self.say(kind)}</label><input name=x>" + (f"<p>{self.prose(3, 20)}</p>" if r.random() < 0.4 else "") + (f"<select><option>{self.word()}<option>{self.word()}</select>" if r.random() < 0.2 else "") + f"<button>{self.say(kind)}</button>"
        elif kind == "comments":
            one = lambda: f'<{r.choice(("div", "li", "article"))} class="comment"><p><b>{self.word()}</b> {self.say(kind)}</p><p>{self.prose(5, 60)}</p></{"div"}>'.replace("</div>", "") + ""
            inner = f"<h3>{self.say(kind)}</h3>" + "".join(one() for _ in range(r.randint(1, 4)))
            inner = inner if r.random() < 0.5 else f"<h2>{self.say(kind)}</h2>" + "".join(f"<p>{self.prose(5, 70)}</p>" for _ in range(r.randint(1, 5)))
        elif kind == "notice":
            inner = r.choice(("<p>{}</p>", "{}", "<span>{}</span>")).format(self.say(kind) if r.random() < 0.5 else self.prose(4, 40)) + (f"<button>{self.say(kind)}</button>" if r.random() < 0.5 else "")
        else:
            inner = r.choice(("{}", "<p>{}</p>", "<a href=/x>{}</a>", "<h4>{}</h4>")).format(self.say(kind) if r.random() < 0.4 else self.prose(3, 40))
        return f"\x01{a}{inner}{b}\x02"

    def article(self) -> str:
        r = self.r
        style = r.random()
        a, b = ("<article>", "</article>") if style < 0.45 else self.named("content", ("article", "div", "div", "section", "main"))
        if a == "<section>":
            a = '<section class="content">'
        title = self.prose(2, 14)
        head = f"<h1>{title}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.12:
            head = f"<header>{head}</header>"
        parts = []
        for k in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if k == 0 and r.random() < 0.4:
                parts.append(f"<p><b>{title} {self.prose(2, 60)}<br>")
            elif kind < 0.76:
                text = self.prose(1, r.choice((6, 30, 80, 150)))
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.prose(1, 5)}</a> <em>{self.word()}</em>, {self.prose(1, 12)}'
                parts.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.84:
                parts.append(f"<h{r.randint(2, 4)}>{self.prose(1, 8)}</h{2}>".replace("</h2>", "</p>") if r.random() < 0.1 else f"<h2>{self.prose(1, 8)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.prose(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{self.prose(5, 40)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<pre>{self.prose(3, 20)}</pre>")
            elif kind < 0.975:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}<td>{self.prose(1, 4)}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{self.prose(2, 15)}</figcaption></figure>")
            if r.random() < 0.05:
                parts.append(self.boiler(r.choice(("ad", "ad", "share", "sidebar", "form", "notice"))))
        tail = self.boiler("comments") if r.random() < 0.08 else self.boiler("share") if r.random() < 0.08 else ""
        return f"{a}{head}{''.join(parts)}{tail}{b}"

    def page(self) -> str:
        """Markup in which \\x01 and \\x02 bound what is not article."""
        r = self.r
        before = [self.boiler(k) for k in ("header", "nav", "notice", "ad", "form", "share", "sidebar") if r.random() < {"header": 0.4, "nav": 0.75, "ad": 0.5}.get(k, 0.15)]
        after = [self.boiler(k) for k in ("comments", "sidebar", "ad", "form", "share", "notice", "nav", "footer") if r.random() < {"footer": 0.8, "comments": 0.3, "sidebar": 0.3}.get(k, 0.12)]
        if r.random() < 0.2:
            r.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.35:
            wrap, end = self.r.choice((("<div class=wrapper>", "</div>"), ("<main>", "</main>"), ('<div id="page"><div class="container">', "</div></div>"), ('<main id="main">', "</main>")))
            body = wrap + body + end
        if r.random() < 0.5:
            body = body.replace("><", ">\n<")
        out = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.prose(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'
        return out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.12 else out


MARKS = str.maketrans("", "", "\x01\x02")


def labelled(page: str) -> tuple[list, np.ndarray]:
    """Blocks of a page and which are article: bounds travel through the reader as words of their own."""
    marked = page.replace("\x01", "<p>\x01</p>").replace("\x02", "<p>\x02</p>")
    depth, truth = 0, []
    for text, *_ in H.blocks(marked):
        if text in ("\x01", "\x02"):
            depth += 1 if text == "\x01" else -1
        else:
            truth.append(depth == 0)
    read = H.blocks(page.translate(MARKS))
    return read, np.array(truth, np.float32)


def examples(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for k in range(n):
        read, truth = labelled(Maker(seed * 1_000_003 + k).page())
        if len(read) == len(truth) and len(read):
            xs.append(H.vectors(read))
            ys.append(truth)
    return xs, ys


def start(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for way in ("f", "b"):
        w[f"{way}_in"] = r.normal(0, 0.1, (H.DIM, 4 * HIDDEN))
        w[f"{way}_rec"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"{way}_bias"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    w["out"], w["out_bias"] = r.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)
    return w


def gradients(xs: list[np.ndarray], ys: list[np.ndarray], w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over the blocks of pages, and its gradients by backpropagation through time."""
    lengths = np.array([len(x) for x in xs])
    rows, steps, hid = len(xs), lengths.max(), HIDDEN
    mask = np.arange(steps)[None, :] < lengths[:, None]
    saved, states = {}, []
    for way in ("f", "b"):
        x = np.zeros((rows, steps, H.DIM))
        for k, own in enumerate(xs):
            x[k, : len(own)] = own if way == "f" else own[::-1]
        z = x @ w[f"{way}_in"] + w[f"{way}_bias"]
        h, c = np.zeros((rows, hid)), np.zeros((rows, hid))
        trail, hs = [], np.zeros((rows, steps, hid))
        for t in range(steps):
            a = z[:, t] + h @ w[f"{way}_rec"]
            i, f, o = (H._sigmoid(a[:, k * hid : (k + 1) * hid]) for k in range(3))
            g = np.tanh(a[:, 3 * hid :])
            c_new = f * c + i * g
            th = np.tanh(c_new)
            trail.append((i, f, o, g, c, th, h))
            h, c = o * th, c_new
            hs[:, t] = h
        saved[way] = (x, trail)
        back = np.zeros_like(hs)
        for k, n in enumerate(lengths):
            back[k, :n] = hs[k, :n] if way == "f" else hs[k, :n][::-1]
        states.append(back)
    both = np.concatenate(states, axis=2)
    y = np.zeros((rows, steps))
    for k, own in enumerate(ys):
        y[k, : len(own)] = own
    p = H._sigmoid((both @ w["out"])[:, :, 0] + w["out_bias"])
    n = mask.sum()
    loss = -(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n
    d = (p - y) * mask / n
    grad = {"out": (both * d[:, :, None]).sum((0, 1))[:, None], "out_bias": np.array([d.sum()])}
    d_both = d[:, :, None] * w["out"][:, 0]
    for k, way in enumerate(("f", "b")):
        own = d_both[:, :, k * hid : (k + 1) * hid]
        dh = np.zeros_like(own)
        for r, m in enumerate(lengths):
            dh[r, :m] = own[r, :m] if way == "f" else own[r, :m][::-1]
        x, trail = saved[way]
        dz, h_next, c_next = np.zeros((rows, steps, 4 * hid)), np.zeros((rows, hid)), np.zeros((rows, hid))
        d_rec = np.zeros_like(w[f"{way}_rec"])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, c, th, h = trail[t]
            dh_t = dh[:, t] + h_next
            dc = dh_t * o * (1 - th * th) + c_next
            da = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh_t * th * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dz[:, t] = da
            d_rec += h.T @ da
            h_next, c_next = da @ w[f"{way}_rec"].T, dc * f
        grad[f"{way}_rec"], grad[f"{way}_bias"] = d_rec, dz.sum((0, 1))
        grad[f"{way}_in"] = x.reshape(-1, H.DIM).T @ dz.reshape(-1, 4 * hid)
    return loss, grad


def train(pages: int = 3000, epochs: int = 8, seed: int = 1, batch: int = 32, rate: float = 4e-3) -> dict[str, np.ndarray]:
    xs, ys = examples(pages, seed)
    w = start(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    groups = [g for g in np.array_split(np.argsort([len(x) for x in xs], kind="stable"), max(1, len(xs) // batch))]
    for epoch in range(epochs):
        total = 0.0
        for g in r.permutation(len(groups)):
            own = groups[g]
            # path parts and words are left out at random, so that no single one decides
            keep = [(r.random((len(xs[k]), H.DIM)) > 0.12) for k in own]
            loss, grad = gradients([xs[k] * d for k, d in zip(own, keep)], [ys[k] for k in own], w)
            step += 1
            total += loss
            size = np.sqrt(sum((x * x).sum() for x in grad.values()))
            for k in w:
                gk = grad[k] * min(1, 1 / (size + 1e-9)) + 1e-6 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] -= rate * (0.3 if epoch > epochs * 0.6 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch + 1}: loss {total / len(groups):.4f}", flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], pages: int = 500, seed: int = 77) -> float:
    """Share of blocks labelled right on pages that training has not seen."""
    xs, ys = examples(pages, seed)
    w = {k: x.astype(np.float32) for k, x in w.items()}
    marks = H.label(xs, w)
    return float(np.mean(np.concatenate([(p >= 0.5) == (y > 0) for p, y in zip(marks, ys)])))


def main() -> None:
    pages, epochs = (int(x) for x in (sys.argv[1:] + ["3000", "8"])[:2]) if len(sys.argv) > 2 else (3000, 8)
    w = train(pages, epochs)
    np.savez_compressed(H.MODEL, **{k: x.astype(np.float16) for k, x in w.items()})
    print(f"held-out accuracy {accuracy(H.load_model()):.4f}")


if __name__ == "__main__":
    main()
