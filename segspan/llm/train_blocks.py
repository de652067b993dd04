"""Train the block labeller on generated pages: `python -m segspan.llm.train_blocks`.

Pages are drawn from random site layouts, so the article's container, the order of menus, notices,
adverts, forms, sidebars, comments and footers, and all their names vary; words are random syllables.
Only the generator knows the labels, by a mark around article text.
"""

from __future__ import annotations

import random

import numpy as np

from .htmlblocks import INPUT, MODEL, Labeller, blocks, sigmoid, vectors

HIDDEN = 24
MARK = "⁣"  # an invisible character before every article block


def words(r: random.Random, lo: int, hi: int) -> str:
    w = ["".join(r.choice("bcdfghlmnprstvw") * r.randint(0, 1) + r.choice("aeiouéüñ") + r.choice(["", "", "n", "r", "s", "t", "ng"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
    if r.random() < 0.1:
        w = [x.upper() for x in w]
    if r.random() < 0.1:
        w = [x + r.choice(["!!", "###", "$$$", "&amp;&amp;", "%%%"]) for x in w]
    for k in range(r.randint(4, 9), len(w), r.randint(5, 12)):
        w[k] += r.choice([".", ",", ".", ";"])
    return " ".join(w).capitalize() + r.choice([".", ".", ".", "", "!"])


def named(r: random.Random, tag: str, names: list[str], chance: float = 0.9) -> str:
    own = r.choice(names) if r.random() < chance else ""
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 6))) if r.random() < 0.25 else ""
    value = " ".join(x for x in (own, noise) if x)
    return f'<{tag} {r.choice(["class", "class", "id"])}="{value}">' if value else f"<{tag}>"


def article(r: random.Random) -> str:
    out = []
    open_p = r.random() < 0.3
    if r.random() < 0.85:
        out.append(f"<h1>{MARK}{words(r, 2, 10)}</h1>")
    n = 0 if r.random() < 0.02 else r.choice([1, 1, 2, 3, 5, 8, 15, 30])
    for _ in range(max(1, n)):
        kind = r.random()
        text = words(r, *r.choice([(1, 4), (5, 20), (10, 80), (60, 200)]))
        if kind < 0.72:
            if r.random() < 0.25:
                text = f"<b>{text}" + ("</b>" if r.random() < 0.6 else "")
            if r.random() < 0.2:
                text += f' <a href="/{words(r, 1, 1)}">{words(r, 1, 4)}</a> {words(r, 2, 9)}'
            if r.random() < 0.25:
                text += f"<br>{MARK}{words(r, 1, 30)}"
            out.append(f"<p>{MARK}{text}" + ("" if open_p else "</p>"))
        elif kind < 0.8:
            out.append(f"<h{r.choice('234')}>{MARK}{words(r, 1, 8)}</h2>")
        elif kind < 0.87:
            out.append("<ul>" + "".join(f"<li>{MARK}{words(r, 2, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
        elif kind < 0.91:
            out.append(f"<blockquote>{MARK}{text}</blockquote>")
        elif kind < 0.94:
            out.append("<table>" + "".join(f"<tr><td>{MARK}{words(r, 1, 3)}</td><td>{MARK}{words(r, 1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.97:
            out.append(f"<pre>{MARK}{text}</pre>")
        else:
            out.append(f"<figure><img src=x><figcaption>{MARK}{words(r, 2, 9)}</figcaption></figure>")
        if r.random() < 0.04:
            out.append(f'{named(r, "div", ["ad", "advert", "banner", "sponsor", "promo", "share", "social", "related"], 1)}{words(r, 1, 12)}</div>')
    return "".join(out)


def links(r: random.Random, lo: int, hi: int) -> str:
    items = [f'<a href="/{words(r, 1, 1)}">{words(r, 1, 3)}</a>' for _ in range(r.randint(lo, hi))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else r.choice([" ", " | ", "<br>"]).join(items)


def menu(r: random.Random) -> str:
    tag = r.choice(["nav", "nav", "div", "header"])
    return f'{named(r, tag, ["menu", "nav", "navbar", "navigation", "topnav", "breadcrumb", "main-menu"], 1 if tag == "div" else 0.4)}{links(r, 2, 12)}</{tag}>'


def header(r: random.Random) -> str:
    tag = r.choice(["header", "header", "div"])
    return f'{named(r, tag, ["header", "masthead", "site-header", "top", "branding", "logo"], 1 if tag == "div" else 0.4)}{r.choice(["<h1>", "<div>", "<p>", "<span>"])}{words(r, 1, 5)}{"<p>" + words(r, 2, 9) if r.random() < 0.4 else ""}</{tag}>'


def notice(r: random.Random) -> str:
    return f'{named(r, r.choice(["div", "section", "aside"]), ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"], 1)}<p>{words(r, 5, 60)}</p>{"<button>" + words(r, 1, 2) + "</button>" if r.random() < 0.5 else ""}</div>'


def advert(r: random.Random) -> str:
    return f'{named(r, r.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement"], 1)}{words(r, 2, 40)}</div>'


def form(r: random.Random) -> str:
    return f'{named(r, "form", ["search", "login", "subscribe", "contact"], 0.5)}<label>{words(r, 1, 4)}</label><input type="text"><select><option>{words(r, 1, 2)}</option></select><p>{words(r, 2, 20)}</p><button>{words(r, 1, 2)}</button></form>'


def sidebar(r: random.Random) -> str:
    tag = r.choice(["aside", "aside", "div"])
    inner = r.choice([lambda: links(r, 2, 8), lambda: f"<h3>{words(r, 1, 4)}</h3>{links(r, 2, 8)}", lambda: f"<h3>{words(r, 1, 4)}</h3><p>{words(r, 5, 60)}</p>"])()
    return f'{named(r, tag, ["sidebar", "side", "widget", "related", "recommended", "popular", "secondary", "more"], 1 if tag == "div" else 0.5)}{inner}</{tag}>'


def comments(r: random.Random) -> str:
    tag = r.choice(["div", "section", "ol", "ul"])
    item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
    body = "".join(f'{named(r, item, ["comment", "reply", "response"], 0.7)}{"<b>" + words(r, 1, 2) + "</b>" if r.random() < 0.5 else ""}<p>{words(r, 3, 80)}</p></{item}>' for _ in range(r.randint(1, 8)))
    return f'{named(r, tag, ["comments", "commentlist", "comment-list", "discussion", "responses", "disqus", "reader-comments"], 1)}{"<h3>" + words(r, 1, 3) + "</h3>" if r.random() < 0.5 else ""}{body}</{tag}>'


def footer(r: random.Random) -> str:
    tag = r.choice(["footer", "footer", "div"])
    return f'{named(r, tag, ["footer", "site-footer", "bottom", "copyright", "legal"], 1 if tag == "div" else 0.3)}&copy; {words(r, 2, 40)}{links(r, 1, 6) if r.random() < 0.5 else ""}</{tag}>'


def page(r: random.Random) -> str:
    tag, names = r.choice([("article", ["post", "entry", "story"]), ("article", ["post"]), ("main", ["content", "main"]), ("div", ["content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "text", "body"]), ("section", ["content", "article", "post"]), ("td", ["content", "main"])])
    before = [f(r) for f in r.sample([menu, header, notice, advert, form, sidebar, advert, menu], r.randint(0, 5))]
    after = [f(r) for f in r.sample([footer, comments, sidebar, advert, form, notice, comments, footer], r.randint(0, 5))]
    main = f'{named(r, tag, names, 0.35 if tag in ("article", "main") else 1)}{article(r)}</{tag}>'
    if tag == "td":
        main = f"<table><tr>{main}</tr></table>"
    if r.random() < 0.3:
        main = f"<main>{main}</main>" if tag != "main" else f"<div>{main}</div>"
    if r.random() < 0.3:
        main = f'{named(r, "div", ["container", "wrapper", "page", "site", "row", "inner"], 1)}{"".join(before)}{main}{"".join(after)}</div>'
        before = after = []
    comment = f"<!-- {words(r, 1, 4)} -->" if r.random() < 0.4 else ""
    return f'<!DOCTYPE html><html><head><title>{words(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(before)}{comment}{main}{"".join(after)}</body></html>'


def sample(seed: int, n: int) -> list[tuple[list, np.ndarray]]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        b = blocks(page(r))
        y = np.array([MARK in x.text for x in b], np.float32)
        for x in b:
            x.text = x.text.replace(MARK, "").strip() or "x"
        if b:
            out.append((b, y))
    return out


def backward(model: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients by backpropagation through time."""
    steps, n, hidden = x.shape[0], x.shape[1], model.hidden
    grads = {k: np.zeros_like(v) for k, v in model.w.items()}
    states, outs = {}, {}
    for side in "fb":
        xs, ms = (x, mask) if side == "f" else (x[::-1], mask[::-1])
        w, u, b = (model.w[k + side] for k in "wub")
        h = c = np.zeros((n, hidden), np.float32)
        trace = []
        out = np.zeros((steps, n, hidden), np.float32)
        for t in range(steps):
            z = xs[t] @ w + b + h @ u
            g, s = np.tanh(z[:, 3 * hidden :]), sigmoid(z[:, : 3 * hidden])
            i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            m = ms[t][:, None]
            trace.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[t] = h
        states[side], outs[side] = trace, out
    both = np.concatenate([outs["f"], outs["b"][::-1]], 2)
    p = sigmoid(both @ model.w["wo"] + model.w["bo"])[..., 0]
    total = mask.sum()
    loss = -float((np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / total)
    d = ((p - y) * mask / total)[..., None].astype(np.float32)
    grads["wo"] = both.reshape(-1, 2 * hidden).T @ d.reshape(-1, 1)
    grads["bo"] = d.sum((0, 1))
    dboth = d @ model.w["wo"].T
    for side in "fb":
        xs = x if side == "f" else x[::-1]
        dout = dboth[..., :hidden] if side == "f" else dboth[::-1, :, hidden:]
        dh = dc = np.zeros((n, hidden), np.float32)
        u = model.w["u" + side]
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = states[side][t]
            dh = dh + dout[t]
            dhm, dcm = dh * m, dc * m
            dct = dcm + dhm * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
            grads["w" + side] += xs[t].T @ dz
            grads["u" + side] += h.T @ dz
            grads["b" + side] += dz.sum(0)
            dh, dc = dz @ u.T + dh * ~m, dct * f + dc * ~m
    return loss, grads


def fit(pages: list, epochs: int = 5, batch: int = 32, rate: float = 4e-3, seed: int = 1) -> Labeller:
    r = np.random.default_rng(seed)
    weights = {}
    for side in "fb":
        weights["w" + side] = r.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
        weights["u" + side] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        weights["b" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    weights |= {"wo": r.normal(0, 0.3, (2 * HIDDEN, 1)), "bo": np.zeros(1)}
    model = Labeller(weights)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        losses = []
        for k in r.permutation(len(groups)):
            own = [pages[p] for p in groups[k]]
            x, bounds = vectors([b for b, _ in own])
            steps = max(len(b) for b, _ in own)
            px, mask, y = np.zeros((steps, len(own), INPUT), np.float32), np.zeros((steps, len(own)), bool), np.zeros((steps, len(own)), np.float32)
            for q, (b, labels) in enumerate(own):
                px[: len(b), q], mask[: len(b), q], y[: len(b), q] = x[bounds[q] : bounds[q + 1]], True, labels
            loss, grads = backward(model, px, mask, y)
            losses.append(loss)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                model.w[name] -= rate * (0.5**epoch) * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
                model.w[name] = model.w[name].astype(np.float32)
        print(f"epoch {epoch}: loss {np.mean(losses):.4f}", flush=True)
    return model


def accuracy(model: Labeller, pages: list) -> float:
    found = model.label([b for b, _ in pages])
    return float(np.mean(np.concatenate([f == (y > 0) for f, (_, y) in zip(found, pages, strict=True)])))


if __name__ == "__main__":
    trained = fit(sample(1, 6000))
    print("held-out accuracy", accuracy(trained, sample(2, 1000)))
    np.savez_compressed(MODEL, **trained.w)
