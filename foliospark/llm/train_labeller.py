"""Train the block labeller on generated pages: ``python -m foliospark.llm.train_labeller``.

Pages are put together from shells (where the article sits and how it is marked),
boilerplate parts (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) in random order and number, and invented words; sloppy markup is thrown in.
Half of the pages are of wilder make (``Wild``): words of real languages and scripts in
the article and in what stands beside it, class names that say nothing or none at all,
and layouts of many kinds. PAGES bounds the sample.
"""

from __future__ import annotations

import random

import numpy as np

from foliospark.llm.html_blocks import Block, blocks
from foliospark.llm.labeller import LEAF, PATH, WEIGHTS, WIDTH, WORDS, Labeller, features

PAGES, HELD_OUT = 16000, 800
_IN, _OUT = "␂", "␃"  # marks that the generator puts on texts, taken off before reading


class Writer:
    """Writes one page; texts of the article are marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["aeioustrnldmhg", "aeiouéèçtrslnm", "aeiouäöüßschtn", "aeiouáñíótrslc", "aeiouyzkwvbpfj"])
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(300)]

    def text(self, low: int, high: int, mark: str) -> str:
        n = self.r.randint(low, high)
        w = [self.r.choice(self.words) for _ in range(n)]
        w[0] = w[0].capitalize()
        end = self.r.choice([".", ".", ".", "!", "?", ""]) if n > 3 else self.r.choice(["", "."])
        return f"{mark}{' '.join(w)}{end}"

    def link(self, mark: str, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.text(low, high, mark)}</a>'

    def named(self, tags: list[str], names: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        attr = ""
        if names and (tag == "div" or tag == "section" or tag == "ul" or self.r.random() < 0.5):
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def menu(self) -> str:
        items = "".join(f"<li>{self.link(_OUT)}</li>" if self.r.random() < 0.9 else f"<li>{self.link(_OUT)}" for _ in range(self.r.randint(2, 9)))
        return self.named(["nav", "nav", "nav", "div", "ul"], ["menu", "nav", "navbar", "main-nav", "navigation", "breadcrumb", "topnav"], f"<ul>{items}</ul>" if self.r.random() < 0.8 else " ".join(self.link(_OUT) for _ in range(5)))

    def head(self) -> str:
        return self.named(["header", "header", "div"], ["header", "masthead", "site-header", "top", "logo", "banner"], f"<{self.r.choice(['h1', 'div', 'p', 'span', 'h2'])}>{self.text(1, 6, _OUT)}</div>" + (f"<p>{self.text(2, 10, _OUT)}</p>" if self.r.random() < 0.4 else ""))

    def foot(self) -> str:
        inner = self.r.choice(["&copy; ", "&copy; 2021 ", ""]) + self.text(1, 5, _OUT) + " &middot; " + self.text(3, 30, "")
        return self.named(["footer", "footer", "footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal"], inner if self.r.random() < 0.6 else f"<p>{inner}</p><ul><li>{self.link(_OUT)}<li>{self.link(_OUT)}</ul>")

    def aside(self) -> str:
        inner = f"<h3>{self.text(1, 4, _OUT)}</h3>" + "".join(f"<p>{self.text(4, 40, _OUT)}</p>" if self.r.random() < 0.5 else f"<li>{self.link(_OUT, 2, 8)}</li>" for _ in range(self.r.randint(1, 5)))
        return self.named(["aside", "aside", "div", "section"], ["sidebar", "side", "related", "widget", "recommended", "popular", "trending", "more-stories"], inner)

    def notice(self) -> str:
        inner = f"<p>{self.text(5, 40, _OUT)}</p>" if self.r.random() < 0.6 else self.text(5, 40, _OUT)
        return self.named(["div", "div", "section", "aside"], ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "paywall", "message", "popup", "cookies banner"], inner + (f"<button>{self.text(1, 2, _OUT)}</button>" if self.r.random() < 0.5 else ""))

    def advert(self) -> str:
        inner = self.text(3, 40, _OUT) if self.r.random() < 0.6 else f"<p>{self.text(3, 30, _OUT)}</p>{self.link(_OUT)}"
        return f"<!-- ad {self.r.randint(0, 99)} -->" * self.r.randint(0, 1) + self.named(["div"], ["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "sponsor", "banner-ad"], inner)

    def form(self) -> str:
        inner = f"<label>{self.text(1, 4, _OUT)}</label><input name=q><button>{self.text(1, 2, _OUT)}</button>"
        if self.r.random() < 0.5:
            inner = f"<p>{self.text(3, 15, _OUT)}</p>" + inner
        return self.named(["form", "form", "div"], ["newsletter", "subscribe", "search", "login", "signup", "form", "share", "social"], inner)

    def comments(self) -> str:
        one = lambda: self.named(["div", "li", "article", "p"], ["comment", "comment-body", "reply", "comment-text"], (f"<b>{self.text(1, 2, _OUT)}</b> " if self.r.random() < 0.5 else "") + f"<p>{self.text(3, 50, _OUT)}</p>")
        return self.named(["section", "div", "div", "ol"], ["comments", "comment-list", "discussion", "responses", "reader-comments", "respond"], f"<h3>{self.text(1, 3, _OUT)}</h3>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 6))))

    def article(self, strict: bool) -> str:
        r = self.r
        out = []
        head = self.text(3, 12, _IN)
        if r.random() < 0.9:
            out.append(f"<{(t := r.choice(['h1', 'h1', 'h1', 'h2']))}>{head}</{t}>")
        for _ in range(r.choice([1, 2, 3, 4, 5, 7, 9, 14, 25])):
            x = r.random()
            if x < 0.62:
                p = self.text(r.choice([2, 5, 12, 30]), 80, _IN)
                if r.random() < 0.15:
                    p += f" {self.link('')} " + self.text(1, 8, "")
                if r.random() < 0.1:
                    p += f"<br>{self.text(4, 20, '')}"
                out.append(f"<p>{p}</p>" if r.random() < 0.85 else f"<p>{p}")
            elif x < 0.74:
                out.append(f"<p><b>{self.text(3, 14, _IN)}" + ("<br>" if r.random() < 0.7 else "</b></p>"))
            elif x < 0.82:
                out.append(f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{self.text(1, 8, _IN)}</{t}>")
            elif x < 0.88:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.text(2, 25, _IN)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif x < 0.92:
                out.append(f"<blockquote>{self.text(6, 40, _IN)}</blockquote>" if r.random() < 0.5 else f"<pre>{self.text(5, 40, _IN)}</pre>")
            elif x < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.text(1, 4, _IN)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.97 and not strict:
                out.append(f"<div>{self.text(10, 60, _IN)}</div>")
            elif x < 0.985:
                out.append(self.advert())
            else:
                out.append(self.form() if r.random() < 0.5 else self.aside())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.45  # the simplest shell, as most feeds of pages have it
        before = [self.menu()] if plain else [f() for f in r.sample([self.menu, self.head, self.notice, self.advert, self.form, self.aside, self.menu], r.randint(0, 5))]
        after = [] if plain else [f() for f in r.sample([self.comments, self.comments, self.aside, self.advert, self.form, self.notice, self.menu], r.randint(0, 4))]
        if plain or r.random() < 0.5:
            before.append(self.advert())
        if plain or r.random() < 0.8:
            after.append(self.foot())
        body = self.article(plain)
        if plain or r.random() < 0.6:
            body = f"<article>{body}</article>"
        else:
            name = r.choice(["content", "main", "post", "entry-content", "article-body", "story", "text", "article", "page-content"])
            body = r.choice([f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>', f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<section class="{name}">{body}</section>', f"<div>{body}</div>"])
        if not plain and r.random() < 0.3:
            body = f'<div class="{r.choice(["wrap", "container", "page", "row", "layout"])}">{body}</div>'
        script = "<script>var a='</p>';</script>" * r.randint(0, 1)
        title = f"<title>{self.text(2, 8, '')}</title>"
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><meta charset=utf-8>{title}<style>p{{}}</style>{script}</head><body>{''.join(before)}{body}{''.join(after)}{end}"


#: Frequent words, and what menus, feet, notices, comments, forms and sidebars say, by language.
TONGUES = {
    "en": (
        "the of and to in a is that was for on with as by at from it which their were has been this its not are",
        "Home|News|Sport|About us|Contact|Products|Blog|Shop|Login|Sign in|Log in|Register|Next|Previous|Edit|View history|Talk|Main page|Random article|FAQ|Forum|Archive",
        "All rights reserved.|Privacy policy|Terms of use|Copyright 2019|Powered by|Imprint|Site map|This page was last edited on 3 May 2020.",
        "We use cookies to improve your experience.|By using this site you agree to our terms.|Accept all cookies|Please enable JavaScript to use this site.|Subscribe to continue reading.",
        "says:|Reply|wrote on|Great article, thanks!|I do not agree with this.|Comments|Leave a comment|Posted by|3 comments",
        "Subscribe to our newsletter|Your email address|Search|Send|Share|Tweet|Share on Facebook|Password|Sign up",
        "Related articles|Most read|You may also like|Popular posts|Recent posts|Categories|Tags|Advertisement|Sponsored|Latest news",
    ),
    "de": (
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
        "Startseite|Nachrichten|Über uns|Kontakt|Produkte|Anmelden|Weiter|Zurück|Bearbeiten|Suche|Archiv|Hilfe|Politik|Wirtschaft",
        "Alle Rechte vorbehalten.|Impressum|Datenschutz|AGB|Nutzungsbedingungen",
        "Diese Seite verwendet Cookies.|Wir verwenden Cookies, um Inhalte zu personalisieren.|Alle akzeptieren|Bitte aktivieren Sie JavaScript.",
        "sagt:|Antworten|schrieb am|Kommentare|Kommentar schreiben|Danke für den Artikel!",
        "Newsletter abonnieren|Ihre E-Mail-Adresse|Suchen|Absenden|Teilen|Passwort",
        "Mehr zum Thema|Meistgelesen|Ähnliche Artikel|Das könnte Sie auch interessieren|Anzeige|Kategorien",
    ),
    "fr": (
        "le la les de des et en un une du dans que pour qui par sur est au plus pas avec son ce il se sont aux ou",
        "Accueil|Actualités|À propos|Contact|Boutique|Connexion|Suivant|Précédent|Modifier|Rechercher|Aide",
        "Tous droits réservés.|Mentions légales|Politique de confidentialité|Plan du site",
        "Ce site utilise des cookies.|En poursuivant votre navigation, vous acceptez nos conditions.|Tout accepter",
        "dit :|Répondre|a écrit|Commentaires|Laisser un commentaire|Merci pour cet article !",
        "Abonnez-vous à notre lettre|Votre adresse e-mail|Envoyer|Partager|Mot de passe",
        "À lire aussi|Les plus lus|Articles similaires|Publicité|Catégories",
    ),
    "es": (
        "el la los de y en que a las un por con una su para es al lo como más se del sus le ha o este",
        "Inicio|Noticias|Quiénes somos|Contacto|Tienda|Iniciar sesión|Siguiente|Anterior|Editar|Buscar|Ayuda",
        "Todos los derechos reservados.|Aviso legal|Política de privacidad|Mapa del sitio",
        "Este sitio utiliza cookies.|Al continuar navegando acepta su uso.|Aceptar todo",
        "dice:|Responder|escribió|Comentarios|Deja un comentario|¡Gracias por el artículo!",
        "Suscríbete a nuestro boletín|Tu correo electrónico|Enviar|Compartir|Contraseña",
        "Artículos relacionados|Lo más leído|También te puede interesar|Publicidad|Categorías",
    ),
    "ru": (
        "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой",
        "Главная|Новости|О нас|Контакты|Магазин|Войти|Далее|Назад|Править|Поиск|Помощь",
        "Все права защищены.|Политика конфиденциальности|Карта сайта|Условия использования",
        "Мы используем файлы cookie.|Принять все|Включите JavaScript.",
        "пишет:|Ответить|Комментарии|Оставить комментарий|Спасибо за статью!",
        "Подпишитесь на рассылку|Ваш адрес|Отправить|Поделиться|Пароль",
        "Читайте также|Популярное|Похожие статьи|Реклама|Рубрики",
    ),
    "zh": (
        "的 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到",
        "首页|新闻|关于我们|联系我们|产品|登录|注册|下一页|上一页|编辑|搜索|帮助|体育|财经",
        "版权所有|隐私政策|使用条款|网站地图|京ICP备10000001号",
        "本网站使用Cookie。|继续浏览即表示您同意我们的条款。|全部接受",
        "说：|回复|评论|发表评论|写得很好，谢谢！|网友评论",
        "订阅我们的通讯|电子邮箱|发送|分享|密码",
        "相关文章|热门文章|猜你喜欢|广告|分类|推荐阅读",
    ),
    "ja": (
        "の に は を た が で て と し れ さ ある いる も する から な こと として",
        "ホーム|ニュース|会社概要|お問い合わせ|製品|ログイン|次へ|前へ|編集|検索|ヘルプ",
        "無断転載を禁じます。|プライバシーポリシー|利用規約|サイトマップ",
        "このサイトはクッキーを使用しています。|すべて同意する",
        "より:|返信|コメント|コメントを残す|ありがとうございます！",
        "メールマガジン登録|メールアドレス|送信|シェア|パスワード",
        "関連記事|人気記事|おすすめ|広告|カテゴリー",
    ),
}
_LETTERS = {"ru": "аеиостнрлвкмдпуя", "zh": "".join(chr(0x4E00 + 7 * i) for i in range(600)), "ja": "".join(chr(c) for c in range(0x3042, 0x3094))}
_MENU, _FOOT, _NOTICE, _COMMENT, _FORM, _BESIDE = range(1, 7)


class Wild(Writer):
    """Pages of many layouts, with words that mean something and names that need not."""

    def __init__(self, seed: int):
        super().__init__(seed)
        r = self.r
        self.tongue = r.choice(list(TONGUES))
        said = TONGUES[self.tongue]
        self.common, self.phrases = said[0].split(), [x.split("|") for x in said]
        self.dense = self.tongue in ("zh", "ja")
        letters = _LETTERS.get(self.tongue, "aeioustrnldmhgcpb")
        self.rare = ["".join(r.choice(letters) for _ in range(r.randint(1, 3) if self.dense else r.randint(2, 10))) for _ in range(250)]
        self.words = self.rare
        self.naming = r.choice(["plain", "junk", "junk", "none"])

    def text(self, low: int, high: int, mark: str) -> str:
        r, out = self.r, []
        n = r.randint(low, high)
        if n > 4 and r.random() < 0.02:  # one word over and over
            return mark + " ".join([r.choice(self.rare)] * n * r.choice([1, 10]))
        left = r.randint(5, 20)
        for i in range(n):
            w = r.choice(self.common) if r.random() < 0.4 else r.choice(self.rare)
            if i == 0 or left == 0:
                w = w.capitalize()
            left = r.randint(5, 20) if left == 0 else left - 1
            if left == 0 and i < n - 1:
                w += "。" if self.dense else r.choice([".", ".", ".", "?"])
            elif n > 6 and i < n - 1 and r.random() < 0.08:
                w += "，" if self.dense else ","
            if r.random() < 0.02:
                w = str(r.randint(1, 2030))
            out.append(w)
        end = "" if n < 4 else r.choice(["。", "。", ""] if self.dense else [".", ".", ".", "", "!", "?"])
        return mark + ("" if self.dense else " ").join(out) + end

    def say(self, kind: int, low: int = 1, high: int = 5) -> str:
        return _OUT + self.r.choice(self.phrases[kind]) if self.r.random() < 0.75 else self.text(low, high, _OUT)

    def attr(self, names: list[str]) -> str:
        r = self.r
        if self.naming == "none" or not names:
            return ""
        if self.naming == "junk":
            return f' class="{r.choice(["css", "c", "x", "sc", "jss", "b", "m"])}-{r.randrange(16**4):04x}{r.choice(["", "-" + r.choice(self.rare[:40])])}"' if r.random() < 0.7 else ""
        return f' {r.choice(["class", "id"])}="{r.choice(names)}"'

    def named(self, tags: list[str], names: list[str], inner: str) -> str:
        tag = self.r.choice(["div", *tags] if self.naming == "plain" else ["div", "div", "div", *tags])
        return f"<{tag}{self.attr(names)}>{inner}</{tag}>"

    def links(self, kind: int, n: int) -> str:
        one = lambda: f'<a href="/{self.r.randrange(999)}">{self.say(kind)}</a>'
        return self.r.choice(["<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>", self.r.choice([" ", " | ", " &middot; "]).join(one() for _ in range(n)), "".join(f"<div>{one()}</div>" for _ in range(n)), "".join(f"{one()}<br>" for _ in range(n))])

    def menu(self) -> str:
        return self.named(["nav", "ul"], ["menu", "nav", "navbar", "navigation", "mw-navigation", "breadcrumbs", "top-menu"], self.links(_MENU, self.r.randint(2, 9)))

    def head(self) -> str:
        title = self.text(1, 3, _OUT)
        inner = self.r.choice([f'<a href="/">{title}</a>', f"<div>{title}</div>", f'<h1><a href="/">{title}</a></h1>']) + (f"<p>{self.text(2, 8, _OUT)}</p>" if self.r.random() < 0.3 else "")
        return self.named(["header"], ["header", "masthead", "logo", "top", "site-title"], inner + (self.links(_MENU, 4) if self.r.random() < 0.4 else ""))

    def foot(self) -> str:
        inner = f"{self.r.choice(['&copy; ', '© 2020 ', ''])}{self.say(_FOOT)}" + (f" {self.text(2, 8, '')}" if self.r.random() < 0.4 else "")
        return self.named(["footer", "footer"], ["footer", "bottom", "copyright", "ft"], self.r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p>{self.links(_FOOT, 3)}"]))

    def notice(self) -> str:
        inner = self.say(_NOTICE, 5, 20) + (f" {self.text(3, 15, '')}" if self.r.random() < 0.3 else "")
        if self.r.random() < 0.2:
            return f"<noscript>{inner}</noscript>"
        return self.named(["div", "aside"], ["cookie-bar", "consent", "notice"], self.r.choice([inner, f"<p>{inner}</p>"]) + f"<button>{self.say(_NOTICE, 1, 2)}</button>" * self.r.randint(0, 1))

    def aside(self) -> str:
        return self.named(["aside", "aside", "section"], ["sidebar", "related", "widget", "right"], f"<{(t := self.r.choice(['h3', 'div', 'h4', 'b']))}>{_OUT}{self.r.choice(self.phrases[_BESIDE])}</{t}>" + self.links(_BESIDE, self.r.randint(2, 7)))

    def advert(self) -> str:
        return self.named(["aside"], ["ad", "banner", "advert", "sponsored"], f"{_OUT}{self.r.choice(self.phrases[_BESIDE][-3:])}" if self.r.random() < 0.5 else f'<a href="/ad">{self.text(2, 12, _OUT)}</a>')

    def form(self) -> str:
        return self.named(["form", "form"], ["newsletter", "search", "login", "share"], f"<label>{self.say(_FORM)}</label><input name=q><button>{self.say(_FORM)}</button>")

    def comments(self) -> str:
        one = lambda: self.named(["li"], ["comment", "reply"], f"<div>{self.text(1, 2, _OUT)} {self.r.choice(self.phrases[_COMMENT])}</div><p>{self.say(_COMMENT, 4, 5) if self.r.random() < 0.3 else self.text(3, 40, _OUT)}</p>")
        return self.named(["section"], ["comments", "responses"], f"<h3>{_OUT}{self.r.choice(self.phrases[_COMMENT])}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6))))

    def prose(self, low: int, high: int) -> str:
        """A paragraph's inside, with links, emphasis, formulas and what else stands in running text."""
        r = self.r
        out = self.text(low, high, _IN)
        while r.random() < 0.35:
            out += r.choice([" <a href=/x>{}</a> ", " <b>{}</b> ", " <em>{}</em> ", " <sup>{}</sup> ", " <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {} ", " <code>{}</code> "]).format(self.text(1, 4, "")) + self.text(1, 15, "")
        return out

    def part(self) -> str:
        r = self.r
        t = r.choice(["h2", "h3", "h4"])
        row = lambda c: "<tr>" + "".join(f"<{c}>{self.text(1, 4, _IN)}</{c}>" for _ in range(r.randint(2, 4))) + "</tr>"
        return r.choice([
            lambda: f"<{t}>{self.text(1, 6, _IN)}</{t}>",
            lambda: f"<{(u := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(r.randint(2, 6))) + f"</{u}>",
            lambda: f"<table{self.attr(['infobox', 'wikitable', 'data'])}>" + row("th") * r.randint(0, 1) + "".join(row("td") for _ in range(r.randint(1, 5))) + "</table>",
            lambda: f"<table{self.attr(['infobox'])}>" + "".join(f"<tr><th>{self.text(1, 2, _IN)}</th><td>{self.text(1, 5, _IN)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>",
            lambda: f"<blockquote><p>{self.prose(5, 30)}</p></blockquote>",
            lambda: f"<pre>{self.text(5, 30, _IN)}</pre>",
            lambda: f"<figure><img src=x><figcaption>{self.text(2, 12, _IN)}</figcaption></figure>",
            lambda: f"<noscript><p>{self.text(4, 20, _IN)}</p></noscript>",
            lambda: f"<dl><dt>{self.text(1, 3, _IN)}</dt><dd>{self.text(4, 15, _IN)}</dd></dl>",
            lambda: f"<p>{self.text(1, 4, _IN)}</p>",
        ])()

    def body(self, tag: str = "p") -> str:
        r = self.r
        out = []
        if r.random() < 0.08:  # a chorus, a list of figures: one short paragraph over and over
            short = [self.text(1, 5, _IN) for _ in range(r.randint(1, 3))]
            out += [f"<{tag}>{r.choice(short)}</{tag}>" for _ in range(r.choice([3, 10, 40, 150]))]
        for _ in range(r.choice([1, 2, 2, 3, 4, 6, 9, 15, 15, 60] if r.random() < 0.3 else [1, 2, 3, 5, 8])):
            out.append(f"<{tag}>{self.prose(r.choice([3, 8, 15]), 70)}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>"))
            if r.random() < 0.25:
                out.append(self.part())
        return "".join(out)

    def title(self) -> str:
        h = self.r.choice(["h1", "h1", "h1", "h2", "div"])
        by = f"<{(t := self.r.choice(['p', 'div', 'time']))}>{self.text(1, 5, _IN)}</{t}>" if self.r.random() < 0.25 else ""
        inner = f"<{h}{self.attr(['title', 'headline', 'firstHeading'])}>{self.text(1, 9, _IN)}</{h}>{by}"
        return f"<header>{inner}</header>" if self.r.random() < 0.15 else inner

    def page(self) -> str:
        r = self.r
        kind = r.choice(["divs", "divs", "divs", "main", "wiki", "article", "article", "table", "bare", "forum", "parts"])
        above = [f() for f in r.sample([self.menu, self.head, self.notice, self.advert, self.form, self.menu, self.aside], r.randint(0, 4))]
        below = [f() for f in r.sample([self.comments, self.aside, self.advert, self.form, self.notice, self.menu], r.randint(0, 3))] + [self.foot()] * (r.random() < 0.75)
        wrap = lambda x, tags, names: f"<{(t := r.choice(tags))}{self.attr(names)}>{x}</{t}>"
        if kind == "bare":  # a letter, a story, a plain text: next to nothing but the text itself
            lines = [self.text(2, 6, _IN), *(self.text(8, 60, _IN) for _ in range(r.randint(1, 6))), self.text(1, 4, _IN), self.text(1, 2, _IN)]
            main = r.choice(["<br><br>", "<p>", "<br>", "\n\n"]).join(lines)
            if r.random() < 0.5:
                main = "".join(f"<{(t := r.choice(['p', 'p', 'div']))}>{x}</{t}>" for x in lines)
            above, below = above[: r.randint(0, 1) * r.randint(0, 1)], below[-1:] * (r.random() < 0.3)
        elif kind == "table":
            main = self.title() + r.choice([self.body(), "<br><br>".join(self.prose(8, 60) for _ in range(r.randint(1, 6)))])
            side = f"<td{r.choice(['', ' width=150', ' valign=top'])}>{self.links(_MENU, r.randint(2, 8))}</td>"
            cells = [side, f"<td>{r.choice(['', '<font size=2>'])}{main}</td>"]
            if r.random() < 0.3:
                cells.reverse()
            main = f"<table{r.choice([' border=0', ' width=100%', ''])}>" + (f"<tr><td colspan=2>{self.text(1, 5, _OUT)}</td></tr>" if r.random() < 0.4 else "") + f"<tr>{''.join(cells)}</tr></table>"
            above, below = above[:1], [f"<hr><center>{self.say(_FOOT)}</center>" if r.random() < 0.5 else self.foot()]
        elif kind == "parts":  # the text in boxes side by side
            row = lambda n: "".join(wrap(self.title() + self.body() if r.random() < 0.7 else self.body(), ["div", "div", "section"], ["col", "box", "hero", "part", "intro"]) for _ in range(n))
            main = row(r.randint(1, 2)) + wrap(row(r.randint(2, 3)), ["div", "section"], ["row", "columns"]) * r.randint(0, 1)
            below = below[-1:]
        elif kind == "forum":
            main = (self.title() if r.random() < 0.7 else "") + "".join(wrap(self.prose(6, 60) if r.random() < 0.6 else self.body(), ["div", "li", "div"], ["message", "post", "post-body", "message-text"]) for _ in range(r.randint(2, 7)))
            main = wrap(main, ["div", "main", "div"], ["thread", "topic", "posts"])
            below = [f for f in below if "<h3>" not in f]
        else:
            main = self.title() * (r.random() < 0.95) + self.body("div" if kind == "divs" and r.random() < 0.2 else "p")
            if r.random() < 0.2:
                main = self.title() + wrap(self.body(), ["div", "section"], ["text", "body", "mw-parser-output"])
            if kind == "divs":
                for _ in range(r.randint(1, 4)):
                    main = wrap(main, ["div", "div", "section"], ["content", "bd", "post", "entry", "story", "text", "wrap", "col"])
            elif kind == "main":
                main = f"<main{self.attr(['main'])}>{wrap(main, ['div'], ['content']) if r.random() < 0.7 else main}</main>"
            elif kind == "article":
                main = f"<article{self.attr(['post'])}>{main}</article>"
            else:
                main = wrap(main, ["div"], ["content", "bodyContent", "mw-body"])
                below = [self.menu(), *below[-2:]]
            if r.random() < 0.3:
                main = f"<div{self.attr(['row', 'page', 'container'])}>{''.join(r.sample([main, r.choice([self.aside, self.menu])()], 2))}</div>"
        return f"<html><head><title>{self.text(1, 5, '')}</title></head><body>{''.join(above)}{main}{''.join(below)}" + "</body></html>" * (r.random() < 0.8)


def labelled(seed: int, kind: type[Writer] = Writer) -> tuple[list[Block], np.ndarray] | None:
    """Blocks of a generated page without the marks, and which are main text."""
    found = blocks(kind(seed).page())
    y = np.array([_IN in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(_IN, "").replace(_OUT, "").strip() or "x"
    return (found, y) if found else None


def batches(pages: list[tuple[list[Block], np.ndarray]], rng: np.random.Generator, size: int = 32):
    order = rng.permutation(len(pages))
    for k in range(0, len(order), 16 * size):
        near = sorted(order[k : k + 16 * size], key=lambda i: len(pages[i][0]))
        for a in range(0, len(near), size):
            take = [pages[i] for i in near[a : a + size]]
            steps = max(len(p) for p, _ in take)
            x, mask, y = np.zeros((steps, len(take), WIDTH), np.float32), np.zeros((steps, len(take)), bool), np.zeros((steps, len(take)), np.float32)
            for j, (p, t) in enumerate(take):
                x[: len(p), j], mask[: len(p), j], y[: len(p), j] = features([p]) if isinstance(p[0], Block) else p, True, t
            yield x, mask, y


def train(epochs: int = 8, rate: float = 0.006, seed: int = 1, pages: int = PAGES) -> Labeller:
    data = [p for i in range(pages) if (p := labelled(i, Wild if i % 2 else Writer))]
    data = [(features([p]).astype(np.float16), y) for p, y in data]
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        total, n = 0.0, 0
        for x, mask, y in batches(data, rng, 64):
            step += 1
            x[:, :, PATH + LEAF : PATH + LEAF + WORDS] *= rng.random((1, x.shape[1], 1)) < 0.6  # other pages are in tongues it does not know
            loss, grad = model.gradients(x, mask, y)
            total, n = total + loss, n + 1
            lr = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / n:.4f}", flush=True)
    return model


def accuracy(model: Labeller, first: int = 10_000_000, n: int = HELD_OUT, kind: type[Writer] = Writer) -> tuple[float, float]:
    """Of held-out pages: blocks labelled right, pages without a wrong block."""
    data = [p for i in range(n) if (p := labelled(first + i, kind))]
    got = model.label([p for p, _ in data])
    right = [g == (y > 0) for g, (_, y) in zip(got, data, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    fitted = train()
    for kind in (Writer, Wild):
        print(f"held out, {kind.__name__}: blocks %.4f, pages %.4f" % accuracy(fitted, kind=kind))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in fitted.w.items()})
