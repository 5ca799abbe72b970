"""Makes html_weights.npz: ``python -m plexar.llm.html_train``. Pages are generated with their labels, seeded."""

from __future__ import annotations

import random
import string

import numpy as np

from .html_extract import HIDDEN, INPUT_DIM, WEIGHTS, _sigmoid, blocks_of, label, vectors

MARK = "\x02"  # precedes the text of main blocks in generated pages; blocks_of keeps it, and it is taken off again


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(self.r.choices(string.ascii_lowercase + "éèüäöñçß", k=self.r.choice([2, 2, 3]))) for _ in range(120)]
        self.words = ["".join(self.r.choices(syllables, k=self.r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(1500)]

    def some(self, *x):
        return self.r.choice(x)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def text(self, a: int, b: int) -> str:
        out, start = [], True
        for _ in range(self.r.randint(a, b)):
            w = self.r.choice(self.words)
            out.append(w.capitalize() if start else w)
            start = self.chance(0.12)
            if start:
                out[-1] += "."
            elif self.chance(0.06):
                out[-1] += ","
        return " ".join(out) + ("." if not start else "")

    def junk(self) -> str:
        """A class name that tells nothing."""
        return "".join(self.r.choices(string.ascii_lowercase, k=self.r.randint(2, 7))) + self.some("", "1", "-x", "-wrap", "_in")

    def attrs(self, *names: str) -> str:
        names = [n for n in names if n]
        if self.chance(0.25):
            names.append(self.junk())
        if not names:
            return ""
        if self.chance(0.2):
            return f' id="{self.r.choice(names)}"'
        return f' class="{" ".join(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li{self.attrs() if self.chance(0.1) else ""}><a href="/{i}">{self.text(1, 3).rstrip(".") if self.chance(0.6) else self.r.choice(self.words)}</a></li>' for i in range(n))

    def nav(self) -> str:
        inner = f"<ul>{self.links(self.r.randint(2, 9))}</ul>" if self.chance(0.8) else " | ".join(f'<a href="#">{self.text(1, 2)}</a>' for _ in range(4))
        kind = self.r.randrange(4)
        if kind < 2:
            return f"<nav{self.attrs('')}>{inner}</nav>"
        name = self.some("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc")
        return f"<{self.some('div', 'ul')}{self.attrs(name)}>{self.links(self.r.randint(2, 8))}</div>" if kind == 2 else f'<div{self.attrs(name, self.some("", "top", "main", "site"))}>{inner}</div>'

    def prose(self, a: int = 1, b: int = 3, lo: int = 3, hi: int = 60) -> str:
        return "".join(f"<p>{self.text(lo, hi)}</p>" for _ in range(self.r.randint(a, b)))

    def ad(self) -> str:
        name = self.some("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner")
        inner = self.text(2, 40) if self.chance(0.6) else self.prose(1, 2)
        return f"<{(t := self.some('div', 'div', 'aside', 'section'))}{self.attrs(name)}>{inner}</{t}>"

    def notice(self) -> str:
        name = self.some("cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "gdpr", "overlay", "warning")
        button = f"<button>{self.text(1, 2)}</button>" if self.chance(0.5) else ""
        return f"<div{self.attrs(name, self.some('', 'banner', 'bar'))}>{self.some(self.text(3, 40), self.prose(1, 2))}{button}</div>"

    def header(self) -> str:
        inner = self.some(f"<h1>{self.text(1, 5)}</h1>", f"<p>{self.text(2, 10)}</p>", self.text(1, 6), f'<a href="/">{self.text(1, 3)}</a>')
        more = self.nav() if self.chance(0.5) else ""
        if self.chance(0.7):
            return f"<header{self.attrs()}>{inner}{more}</header>"
        return f"<div{self.attrs(self.some('header', 'masthead', 'topbar', 'logo'))}>{inner}{more}</div>"

    def footer(self) -> str:
        inner = self.some(f"&copy; {self.text(1, 3)} &middot; {self.text(2, 30)}", self.prose(1, 2, 2, 40), f"<ul>{self.links(4)}</ul>", self.text(2, 40))
        if self.chance(0.75):
            return f"<footer{self.attrs()}>{inner}</footer>"
        return f"<div{self.attrs(self.some('footer', 'copyright', 'colophon', 'bottom'))}>{inner}</div>"

    def side(self) -> str:
        head = f"<h{self.some(2, 3, 4)}>{self.text(1, 4)}</h{3}>" if self.chance(0.5) else ""
        inner = self.some(f"<ul>{self.links(self.r.randint(2, 7))}</ul>", self.prose(1, 3), self.text(3, 40))
        if self.chance(0.5):
            return f"<aside{self.attrs(self.some('', 'sidebar'))}>{head}{inner}</aside>"
        name = self.some("sidebar", "side", "widget", "related", "recommended", "share", "social", "author", "tags", "popular", "trending", "more")
        return f"<{(t := self.some('div', 'section'))}{self.attrs(name)}>{head}{inner}</{t}>"

    def form(self) -> str:
        return f'<form{self.attrs()}><label>{self.text(1, 6)}</label><input type="text">{self.some("", self.prose(1, 1), f"<legend>{self.text(1, 4)}</legend>")}<button>{self.text(1, 2)}</button></form>'

    def comments(self) -> str:
        one = lambda: self.some(f"<p>{self.text(2, 50)}</p>", f"<li>{self.text(2, 50)}</li>", f"<div{self.attrs('comment')}>{self.some(self.text(3, 50), self.prose(1, 2))}</div>", f"<article{self.attrs('comment')}><p>{self.text(3, 40)}</p></article>")
        head = f"<h3>{self.text(1, 3)}</h3>" if self.chance(0.5) else ""
        name = self.some("comments", "comments", "comment", "replies", "responses", "discussion", "respond")
        return f"<{(t := self.some('div', 'section', 'div', 'ol', 'aside'))}{self.attrs(name, self.some('', 'list', 'area'))}>{head}{''.join(one() for _ in range(self.r.randint(1, 6)))}</{t}>"

    def main_block(self) -> str:
        k = self.r.randrange(20)
        t = lambda a, b: MARK + self.text(a, b)
        if k < 11:
            return f"<p>{t(1, 4) if self.chance(0.2) else t(2, 90)}{'</p>' if self.chance(0.85) else ''}"
        if k == 11:
            return f"<p><b>{t(2, 60)}<br>"
        if k == 12:
            return f"<h{self.some(2, 2, 3)}>{t(1, 8)}</h2>"
        if k == 13:
            return f"<ul>{''.join(f'<li>{t(1, 25)}</li>' for _ in range(self.r.randint(1, 6)))}</ul>"
        if k == 14:
            return f"<blockquote>{self.some(t(4, 50), '<p>' + t(4, 50) + '</p>')}</blockquote>"
        if k == 15:
            return f"<pre>{t(3, 40)}</pre>"
        if k == 16:
            return f"<table><tr><td>{t(1, 6)}</td><td>{t(1, 6)}</td></tr></table>"
        if k == 17:
            return f"<figure><img src=x><figcaption>{t(2, 15)}</figcaption></figure>"
        if k == 18:
            return f'<p>{t(2, 30)} <a href="/x">{self.text(1, 12)}</a> {self.text(1, 20)}</p>'
        return f"<div{self.attrs()}>{t(3, 60)}</div>"

    def article(self) -> str:
        parts = [f"<h1>{MARK}{self.text(1, 14)}</h1>"] if self.chance(0.85) else []
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            parts.append(self.main_block())
            if self.chance(0.06):
                parts.append(self.some(self.ad, self.side, self.form, self.notice, self.nav)())
        inner = "".join(parts)
        if self.chance(0.12):
            inner += self.comments()
        k = self.r.randrange(10)
        if k < 6:
            out = f"<article{self.attrs(self.some('', '', 'post', 'entry'))}>{inner}</article>"
        elif k == 6:
            out = f"<main{self.attrs(self.some('', 'content'))}>{inner}</main>"
        elif k == 7:
            out = f'<div role="main">{inner}</div>'
        else:
            out = f"<{(t := self.some('div', 'section'))}{self.attrs(self.some('content', 'article', 'post', 'entry', 'story', 'body', 'text', 'main'))}>{inner}</{t}>"
        if self.chance(0.25):
            out = f"<main{self.attrs()}>{out}</main>"
        return out

    def page(self) -> str:
        around = [self.nav, self.ad, self.notice, self.header, self.side, self.form]
        before = "".join(f() for f in [*([self.header] if self.chance(0.4) else []), *([self.nav] if self.chance(0.8) else []), *self.r.sample(around, self.r.choice([0, 1, 1, 2, 3]))])
        after = "".join(f() for f in self.r.sample([self.side, self.comments, self.form, self.ad, self.notice, self.comments], self.r.choice([0, 0, 1, 2, 3]))) + (self.footer() if self.chance(0.85) else "")
        middle = self.article()
        if self.chance(0.35):
            side = self.side()
            middle = f"<div{self.attrs(self.some('', 'wrapper', 'container', 'page', 'row', 'layout'))}>{self.some(middle + side, side + middle)}</div>"
        head = f"<head><title>{self.text(1, 8)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body{self.attrs() if self.chance(0.2) else ''}>{before}{middle}{after}</body></html>"


def labelled(seed: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    made, out = Pages(seed), []
    while len(out) < n:
        blocks = blocks_of(made.page())
        if blocks:
            y = np.array([MARK in b.text for b in blocks], np.float32)
            for b in blocks:
                b.text = b.text.replace(MARK, "") or "x"
            out.append((vectors(blocks), y))
    return out


def _pad(pages):
    longest = max(len(y) for _, y in pages)
    x = np.zeros((longest, len(pages), INPUT_DIM), np.float32)
    y, m = (np.zeros((longest, len(pages)), np.float32) for _ in range(2))
    back = np.zeros((longest, len(pages)), int)  # each page's own reversal; padding stays behind
    for k, (a, b) in enumerate(pages):
        n = len(b)
        x[:n, k], y[:n, k], m[:n, k] = a, b, 1
        back[:, k] = np.r_[np.arange(n)[::-1], np.arange(n, longest)]
    return x, y, m, back


def _forward(x, w, u, b):
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    z, keep = x @ w + b, []
    for t in range(len(x)):
        a = z[t] + h @ u
        g, d = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        new = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * d
        tc = np.tanh(new)
        keep.append((h, c, g, d, tc))
        c, h = new, g[:, 2 * HIDDEN :] * tc
        keep[-1] += (h,)
    return np.stack([k[5] for k in keep]), keep


def _backward(x, u, keep, dh_out):
    n = HIDDEN
    dz = np.empty((*x.shape[:2], 4 * n), np.float32)
    du = np.zeros_like(u)
    dh = dc = 0.0
    for t in range(len(x) - 1, -1, -1):
        h0, c0, g, d, tc, _ = keep[t]
        dh = dh_out[t] + dh
        i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.hstack([dc * d * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - d * d)])
        du += h0.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return dz, du


def train(pages: int = 20000, epochs: int = 14, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = [p for k in range(10) for p in labelled(100 * seed + k, pages // 10)]
    init = lambda *s: rng.normal(0, 0.12, s).astype(np.float32)
    net = {"wo": init(2 * HIDDEN), "wx": init(INPUT_DIM) * 0.1, "bo": np.zeros(1, np.float32)}
    for d in "fb":
        net |= {f"w{d}": init(INPUT_DIM, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda k: (len(data[k][1]) // 6, rng.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        rng.shuffle(batches)
        loss = 0.0
        for rows in batches:
            x, y, mask, back = _pad([data[k] for k in rows])
            cols = np.arange(x.shape[1])
            # now and then a path's bits go, so that no single name decides
            drop = (rng.random((1, x.shape[1], INPUT_DIM)) > 0.03).astype(np.float32)
            x = x * drop
            xb = x[back, cols]
            hf, kf = _forward(x, net["wf"], net["uf"], net["bf"])
            hb, kb = _forward(xb, net["wb"], net["ub"], net["bb"])
            h = np.concatenate([hf, hb[back, cols]], axis=2)
            p = _sigmoid(h @ net["wo"] + x @ net["wx"] + net["bo"])
            loss -= float((mask * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum())
            e = mask * (p - y) / mask.sum()
            g = {"wo": np.einsum("tb,tbh->h", e, h), "wx": np.einsum("tb,tbi->i", e, x), "bo": np.array([e.sum()], np.float32)}
            dh = e[:, :, None] * net["wo"]
            for d, xx, keep, part in (("f", x, kf, dh[:, :, :HIDDEN]), ("b", xb, kb, dh[:, :, HIDDEN:][back, cols])):
                dz, du = _backward(xx, net[f"u{d}"], keep, part)
                g |= {f"w{d}": xx.reshape(-1, INPUT_DIM).T @ dz.reshape(-1, 4 * HIDDEN), f"u{d}": du, f"b{d}": dz.sum((0, 1))}
            step += 1
            rate = 0.006 * (1 - step / (epochs * len(batches))) + 1e-4
            for k, v in net.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                net[k] = (v - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss a block {loss / sum(len(y) for _, y in data):.4f}")
    return net


def accuracy(net, pages: int = 600, seed: int = 999) -> tuple[float, float]:
    """Share of blocks, and of whole pages, labelled right on generated pages that training did not see."""
    made, right, total, whole = Pages(seed), 0, 0, 0
    for _ in range(pages):
        blocks = blocks_of(made.page())
        y = np.array([MARK in b.text for b in blocks])
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "x"
        ok = (label(blocks, net) >= 0.5) == y
        right, total, whole = right + ok.sum(), total + len(ok), whole + ok.all()
    return right / total, whole / pages


if __name__ == "__main__":
    trained = train()
    print("blocks right, pages right:", accuracy(trained))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in trained.items()})
