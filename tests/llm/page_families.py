"""Pages of hand-written layouts, none of which the labeller's own made-up pages come from: (html, article text)."""

import html
import random

ENGLISH = [
    "The river had been rising for three days, and nobody in the village slept.", "By Tuesday the bridge was under water.", "Officials said the dam would hold.",
    "Maria Lopez, who has run the bakery since 1987, moved her ovens to the first floor.", "\"We have seen worse,\" she said, wiping flour from her hands.",
    "Engineers worked through the night to reinforce the eastern bank with sandbags and steel plates.", "The rain stopped at dawn.",
    "Farmers in the valley expect to lose about a third of the harvest, according to the regional council.", "Schools will stay closed until Monday.",
    "Insurance companies have promised to send assessors within the week, though many residents remain sceptical.", "How did it come to this?",
    "A report published last year warned that the levees had not been inspected since the early nineties.", "It was never discussed in parliament.",
    "Volunteers from neighbouring towns brought blankets, soup and, in one case, a piano.", "The mayor thanked them from the steps of the church.",
]
MENU = ["Home", "About us", "News", "Contact", "Archive", "Sports", "Weather", "Services", "Products", "Blog", "Login", "FAQ", "Shop", "Careers"]
ENDS = ["All rights reserved.", "Copyright 2021 Valley Media Ltd. All rights reserved.", "(c) 2019 The Daily. Privacy policy | Terms of use", "© 2023 Example Inc.", "Imprint Privacy Contact"]


class Pages:
    def __init__(self, seed, prose):
        self.r, self.prose = random.Random(seed), prose

    def paragraph(self):
        r = self.r
        return " ".join(r.sample(ENGLISH, r.randint(2, 5))) if r.random() < 0.5 else r.choice(self.prose)

    def article(self):
        return [" ".join(self.r.choice(ENGLISH).split()[:7]).strip(".,"), *(self.paragraph() for _ in range(self.r.randint(3, 7)))]

    def menu(self, form='<a href="/{0}">{0}</a>', between=" "):
        return between.join(form.format(x) for x in self.r.sample(MENU, self.r.randint(3, 7)))

    def figure_and_comments(self):
        t, *ps = self.article()
        code = "for row in table: print(row)"
        body = f"<h1>{t}</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps) + f"<figure><img src=x.png><figcaption>{ENGLISH[1]}</figcaption></figure><pre><code>{code}</code></pre>"
        comments = "".join(f"<li class=comment><b>user{k}</b> <p>{self.r.choice(['Great read!', 'I disagree with this.', 'Thanks for sharing, very helpful.', 'First!'])}</p></li>" for k in range(self.r.randint(1, 4)))
        return f"<!doctype html><html><body><header><a href=/>The Daily</a><nav>{self.menu()}</nav></header><main><article>{body}</article><section id=comments><h2>Comments</h2><ol>{comments}</ol></section></main><footer><p>{self.r.choice(ENDS)}</p></footer></body></html>", [t, *ps, ENGLISH[1], code]

    def without_markup(self):
        ps = self.article()
        return "\n\n".join(map(html.escape, ps)), ps

    def layout_table(self):
        t, *ps = self.article()
        cells = self.menu("<td><a href='{0}.htm'>{0}</a></td>", "")
        return f"<html><body bgcolor=white><table width=760 cellpadding=4><tr>{cells}</tr><tr><td colspan=9><font size=5>{t}</font><br><br>{'<br><br>'.join(map(html.escape, ps))}</td></tr><tr><td colspan=9 align=center><small>{self.r.choice(ENDS)}</small></td></tr></table></body></html>", [t, *ps]

    def side_table(self):
        t, *ps = self.article()
        links = self.menu("<a href='{0}.htm'>{0}</a><br>", "\n")
        return f"<HTML><BODY><CENTER><B>Valley Media</B></CENTER><TABLE><TR><TD VALIGN=top WIDTH=150>{links}</TD><TD><H2>{t}</H2>{''.join(f'<P>{html.escape(p)}' for p in ps)}</TD></TR></TABLE><HR><CENTER>{self.r.choice(ENDS)}</CENTER></BODY></HTML>", [t, *ps]

    def meaningless_names(self):
        t, *ps = self.article()
        name = lambda: "".join(self.r.choice("abcdefghijk0123456789") for _ in range(6))
        a, b, c, d = (name() for _ in range(4))
        return f"<html><body><div class='{a}'><div class='{b}'>{self.menu(between='')}</div></div><div class='{c}'><div class='{d}'>{t}</div>" + "".join(f"<div class='{d}'>{html.escape(p)}</div>" for p in ps) + f"</div><div class='{a}'>{self.r.choice(ENDS)}</div></body></html>", [t, *ps]

    def bare_body(self):
        ps = self.article()[1:]
        return "<html><body>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps) + "</body></html>", ps

    def roles(self):
        t, *ps = self.article()
        return f"<html><body><div role='banner'><span>Valley Media</span></div><div role='navigation'>{self.menu('<span><a href=/{0}>{0}</a></span>')}</div><div role='main'><h1>{t}</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps) + f"</div><div role='complementary'><h3>Related</h3><ul>{self.menu('<li><a href=#>{0}</a></li>', '')}</ul></div><div role='contentinfo'>{self.r.choice(ENDS)}</div></body></html>", [t, *ps]

    def weblog(self):
        t, *ps = self.article()
        return f"<html><body class='single'><div id='page'><div id='masthead' class='site-header'><h1 class='site-title'>My weblog</h1></div><div id='primary' class='content-area'><div class='post hentry'><h2 class='entry-title'>{t}</h2><div class='entry-content'>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps) + f"</div></div></div><div id='secondary' class='widget-area'><div class='widget'><h3>Recent posts</h3><ul>{self.menu('<li><a href=#>{0}</a></li>', '')}</ul></div><form class='search-form'><label>Search</label><input></form></div><div id='colophon' class='site-footer'>{self.r.choice(ENDS)}</div></div></body></html>", [t, *ps]

    def notices_and_adverts(self):
        t, *ps = self.article()
        k = len(ps) // 2
        body = "".join(f"<p>{html.escape(p)}</p>" for p in ps[:k]) + "<div class='ad-slot'>Advertisement</div>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps[k:])
        return f"<html><body><div class='cookie-consent'><p>We use cookies to improve your experience.</p><button>Accept all</button></div><div class='navbar'>{self.menu()}</div><div class='story'><h1>{t}</h1>{body}</div><div class='newsletter'><form><p>Sign up for our newsletter</p><input type=email><button>Subscribe</button></form></div><div class='footer'>{self.r.choice(ENDS)}</div></body></html>", [t, *ps]


FAMILIES = ["figure_and_comments", "without_markup", "layout_table", "side_table", "meaningless_names", "bare_body", "roles", "weblog", "notices_and_adverts"]
