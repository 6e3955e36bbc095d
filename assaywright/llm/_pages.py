"""Pages with known main text, made to train the block labeller: many layouts, element and class names, and invented words."""

from __future__ import annotations

import random

#: Names and phrases usual in page furniture.
NAV = "nav navbar menu menubar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toc skip links toolbar".split()
HEAD = "header masthead banner topbar branding logo site-header page-header sitename tagline".split()
FOOT = "footer site-footer page-footer copyright colophon bottom legal credits footnav".split()
SIDE = "sidebar aside widget side-bar rail secondary related recommended recommendations popular trending more-stories teaser promo-list tags tagcloud archive".split()
ADS = "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad adsense dfp commercial outbrain taboola".split()
NOTE = "cookie cookies cookie-notice consent gdpr notice alert notification popup modal overlay newsletter subscribe signup paywall toast banner-notice disclaimer".split()
COMM = "comments comment comment-list commentlist disqus replies reply reader-comments responses discussion thread user-comments".split()
FORM = "form search searchbox search-form login signin contact register subscribe-form poll".split()
SHARE = "share sharing social social-links follow buttons share-buttons print author-bio byline-links".split()
MAIN = "article content main post entry story body text post-content entry-content article-body story-body main-content page-content article-text richtext prose markdown".split()
PLAIN = "row col container wrapper inner box wrap grid section block module layout page site outer left right center clearfix".split()
PHRASES = {
    "nav": "home|about us|contact|news|sports|login|sign in|register|next|previous|menu|products|services|blog|archive|skip to content|page 2|more",
    "head": "the daily post|your source for news|welcome|site title|search|sign in|my account|english",
    "foot": "copyright 2024 all rights reserved|privacy policy|terms of use|imprint|contact us|powered by|sitemap|about|careers|follow us",
    "side": "related articles|most read|popular posts|recent posts|tags|archives|you may also like|recommended for you|trending now|categories|latest news",
    "ads": "advertisement|sponsored|buy now|limited offer|shop now and save|ad|learn more|promoted content|free shipping today only",
    "note": "we use cookies to improve your experience|accept all cookies|subscribe to our newsletter|please enable javascript|you have 3 free articles left|accept|this site uses cookies|dismiss|read our privacy policy",
    "comm": "comments|leave a reply|reply|great post thanks|i disagree with this|posted by|3 comments|first|thanks for sharing|log in to comment|says",
    "form": "name|email|submit|search|password|your message|send|enter your email|sign up|select a country",
    "share": "share|tweet|share on facebook|print|email this|follow|like|copy link",
}
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur é ü ñ ß ç".split()
#: Frequent words of four languages; with the words of the phrases above they stand in any text, so that none tells furniture by itself.
FREQUENT = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much go good new write our me man too any day same right look think also around another came come work three word must because does part der die und das ist nicht ein eine zu von mit auf den für im dem des sich auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man dann le la les et est un une des que pas dans pour qui sur au avec son plus par ce il ne se nous mais ou leur elle tout été comme être cette fait si même aux on el los las del que en por con una su para se como más este ya porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto".split()
WORDS = sorted({*FREQUENT, *(w for x in PHRASES.values() for w in x.replace("|", " ").split())})
TAGS = {"nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "ads": ["div", "aside", "ins", "section"], "note": ["div", "section", "dialog", "p", "aside"], "comm": ["section", "div", "ol"], "form": ["form", "div", "fieldset"], "share": ["div", "ul"]}
NAMES = {"nav": NAV, "head": HEAD, "foot": FOOT, "side": SIDE, "ads": ADS, "note": NOTE, "comm": COMM, "form": FORM, "share": SHARE}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(FREQUENT if self.r.random() < 0.6 else WORDS)
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        w = [self.word() for _ in range(self.r.randint(least, most))]
        if len(w) > 8 and self.r.random() < 0.5:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + self.r.choice([".", ".", ".", "?", "!"])

    def paragraph(self) -> str:
        if self.r.random() < 0.12:
            return self.word().capitalize() + "."
        if self.r.random() < 0.15:
            return self.junk()
        if self.r.random() < 0.15:
            return self.sentence(2, 7)
        if self.r.random() < 0.03:  # what furniture says too
            return self.r.choice(PHRASES[self.r.choice(sorted(PHRASES))].split("|")).capitalize() + "."
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 7)))

    def junk(self) -> str:
        """Text that is no prose, which articles hold too: columns, repetitions, marks behind words, numbers, capitals."""
        r = self.r
        words = [self.word() for _ in range(r.randint(2, 60))]
        kind = r.randrange(6)
        if kind == 0:
            words = r.choice([" | ", " / ", " · ", "; ", " - ", " > "]).join(words).split(" ")
        elif kind == 1:
            words = [words[0].capitalize()] * r.randint(3, 200)
        elif kind == 2:
            marks = r.sample(["***", "###", "%%%", "$$$", "&amp;&amp;", "!!!", "@", "~", "="], 4)
            words = [w + r.choice(marks) for w in words]
        elif kind == 3:
            words = [str(r.randint(0, 99999)) if r.random() < 0.4 else w for w in words]
        elif kind == 4:
            words = [w.upper() for w in words]
        return " ".join(words) + r.choice(["", "", ".", " |"])

    def attrs(self, names: list[str] | None) -> str:
        r = self.r
        got = []
        if names and r.random() < 0.9:
            got.append(r.choice(names))
        if r.random() < 0.3:
            got.append(r.choice(PLAIN))
        if r.random() < 0.15:
            got.append("css-" + "".join(r.choice("abcdefghijkmnpqrstuvwxyz123456789") for _ in range(6)))
        r.shuffle(got)
        if not got:
            return ""
        if r.random() < 0.25:
            return f' id="{got[0]}"' + (f' class="{" ".join(got[1:])}"' if got[1:] else "")
        return f' class="{" ".join(got)}"'

    def wrap(self, html: str) -> str:
        for _ in range(self.r.choice([0, 0, 1, 1, 2])):
            html = f"<div{self.attrs(PLAIN)}>{html}</div>"
        return html

    def bare(self) -> str:
        """Furniture without a telling name or tag: lists of links, and phrases that only furniture has."""
        r = self.r
        attrs = self.attrs(None)
        if r.random() < 0.6:
            say = lambda: r.choice(PHRASES["nav"].split("|")) if r.random() < 0.4 else self.word() if r.random() < 0.6 else self.sentence(1, 6)
            links = [f'<a href="/{self.word()}">{say()}</a>' for _ in range(r.randint(2, 9))]
            if r.random() < 0.6:
                return f"<ul{attrs}>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
            return f"<{r.choice(['div', 'p'])}{attrs}>" + r.choice([" ", " | ", " &middot; "]).join(links) + "</div>"
        if r.random() < 0.5:
            return f"<{r.choice(['p', 'div'])}{attrs}>&copy; {r.randint(1998, 2025)} {self.word()}" + r.choice(["", ". All rights reserved.", " &middot; " + r.choice(PHRASES["foot"].split("|"))]) + "</p>"
        return f"<{r.choice(['p', 'div'])}{attrs}>{r.choice(PHRASES[r.choice(['note', 'ads', 'share', 'foot'])].split('|')).capitalize()}</p>"

    def furniture(self, kind: str, telling: bool = False) -> str:
        """One piece of page furniture. The tag or the name tells what it is, or, now and then, its words and links."""
        r = self.r
        if not telling and r.random() < 0.08:
            return self.bare()
        tag = r.choice(TAGS[kind])
        own = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        attrs = "" if own else self.attrs(NAMES[kind])
        if not own and not any(n in attrs for n in NAMES[kind]):
            attrs = f' class="{r.choice(NAMES[kind])}"'
        say = lambda: r.choice(PHRASES[kind].split("|")) if r.random() < 0.6 else self.sentence(1, 8)
        n = r.randint(1, 7)
        if tag in ("ul", "ol") or kind == "nav" or (kind in ("side", "foot", "share") and r.random() < 0.5):
            link = lambda t: f'<a href="/{self.word()}">{t}</a>' if r.random() < 0.85 else t
            one = [link(self.word() if kind == "nav" and r.random() < 0.5 else say()) for _ in range(n)]
            items = "".join(f"<li>{x}</li>" for x in one)
            inner = items if tag in ("ul", "ol") else f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(one)
            if kind == "side" and tag not in ("ul", "ol"):
                inner = f"<h3>{say()}</h3>" + inner
        elif kind == "form":
            inner = "".join(f"<label>{say()}</label><input type=text>" for _ in range(n)) + f"<button>{say()}</button>" + ("<select><option>a<option>b</select>" if r.random() < 0.3 else "")
        elif kind == "comm":
            inner = f"<h2>{say()}</h2>" + "".join(f'<div{self.attrs(["comment", "comment-body", "reply"])}><b>{self.word()}</b><p>{self.paragraph() if r.random() < 0.8 else say()}</p></div>' for _ in range(n))
        elif kind in ("ads", "note", "side", "foot", "head"):
            inner = " ".join(f"<p>{say() if r.random() < 0.6 else self.paragraph()}</p>" if r.random() < 0.6 else say() for _ in range(r.randint(1, 3)))
        else:
            inner = " ".join(f"<span>{say()}</span>" for _ in range(n))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def main(self) -> str:
        """The main text in its element: an article, a main, a named one, one with a name that says nothing, or none at all."""
        r = self.r
        out = []
        if r.random() < 0.85:
            h = f"<h1>{self.sentence(2, 10)}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
        for _ in range(r.randint(1, r.choice([2, 16, 16]))):
            k = r.random()
            body = self.paragraph()
            if k < 0.08:
                out.append(f"<h2>{self.sentence(1, 6)}</h2>")
            elif k < 0.12:
                out.append("<ul>" + "".join(f"<li>{self.sentence(1, 10)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.15:
                out.append(f"<blockquote>{body}</blockquote>")
            elif k < 0.18:
                out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.word()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.24:
                out.append(f"<div>{body}</div>")
            elif k < 0.3:
                out.append(f"<p><b>{body}<br>")
            elif k < 0.33:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(2, 8)}</figcaption></figure>")
            elif k < 0.36:
                out.append(f"<pre>{body}</pre>")
            else:
                if r.random() < 0.3:
                    body = body.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
                out.append(f"<p>{body}</p>" if r.random() < 0.9 else f"<p>{body}")
        if r.random() < 0.06:  # one block
            out = ["<br><br>".join(self.paragraph() for _ in range(r.randint(1, 6)))]
        if r.random() < 0.06:  # a licence line that belongs to the article
            out.append(f"<p>{r.choice(PHRASES['foot'].split('|')[:3] + ['all rights reserved']).capitalize()}.</p>")
        if r.random() < 0.25:  # furniture inside the article
            at = r.randint(0, len(out))
            out.insert(at, "\x02" + self.furniture(r.choice(["ads", "share", "side", "note", "nav", "form", "comm"]), telling=True) + "\x01")
        if r.random() < 0.2:  # parts of their own
            a, b = sorted((r.randint(0, len(out)), r.randint(0, len(out))))
            tag = r.choice(["section", "div"])
            out[a:b] = [f"<{tag}{self.attrs(PLAIN) if r.random() < 0.5 else ''}>", *out[a:b], f"</{tag}>"]
        inner = "".join(out)
        k = r.random()
        if k > 0.7:
            if r.random() < 0.4:
                return f"\x01{inner}\x02"
            name = self.attrs(PLAIN) if r.random() < 0.6 else f' id="{r.choice("abcdexyz")}{r.randint(0, 99)}"' if r.random() < 0.7 else ""
            return self.wrap(f"<{r.choice(['div', 'div', 'section', 'td'])}{name}>\x01{inner}\x02</div>")
        k /= 0.7
        if k < 0.5:
            html = f"<article{self.attrs(MAIN) if r.random() < 0.4 else ''}>\x01{inner}\x02</article>"
        elif k < 0.7:
            html = f"<main{self.attrs(MAIN) if r.random() < 0.4 else ''}>\x01{inner}\x02</main>"
        else:
            names = self.attrs(MAIN)
            if not any(n in names for n in MAIN):
                names = f' class="{r.choice(MAIN)}"'
            html = f"<{r.choice(['div', 'section'])}{names}>\x01{inner}\x02</div>"
        if k < 0.5 and r.random() < 0.3:
            html = f"<main>{html}</main>"
        return self.wrap(html)

    def page(self) -> str:
        """A page in which \\x01 begins and \\x02 ends main text."""
        r = self.r
        plain = r.random() < 0.15  # hardly any furniture
        pick = lambda kinds, most: [] if plain and r.random() < 0.8 else [self.wrap(self.furniture(r.choice(kinds))) for _ in range(r.randint(0, most))]
        before = pick(["note", "ads"], 1) + pick(["head", "nav", "nav", "form"], 3) + pick(["ads", "side", "note"], 1)
        after = pick(["share", "side", "ads", "form"], 2) + pick(["comm"], 1) + pick(["side", "nav", "note"], 1) + pick(["foot"], 2)
        body = "".join(before) + self.main() + "".join(after)
        head = f"<head><title>{self.sentence()}</title><style>p{{}}</style><script>var x='<p>';</script></head>" if r.random() < 0.8 else ""
        if r.random() < 0.12:  # no frame
            return body
        names = self.attrs(PLAIN) if r.random() < 0.2 else self.attrs(None) if r.random() < 0.3 else ""
        return f"<!DOCTYPE html><html>{head}<body{names}>{body}</body></html>"
