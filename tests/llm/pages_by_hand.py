"""Pages written by hand in layouts of many sites; ``+`` before a text marks a block of the article.

They are not made by the training generator and were not trained on.
"""

PAGES = {
    "encyclopedia": """<html><head><title>Sea otter</title></head><body><div id="mw-page-base"></div><div id="content"><h1 id="firstHeading">+Sea otter</h1><div id="bodyContent">
<table class="infobox"><tr><th>+Range</th><td>+North Pacific</td></tr><tr><th>+Weight</th><td>+14 to 45 kg</td></tr></table>
<p>+The <b>sea otter</b> is a marine mammal native to the coasts of the northern and eastern <a href="/wiki/P">Pacific Ocean</a>. Adults weigh between 14 and 45 kg.</p>
<p>+Its fur is the densest in the animal kingdom, and it spends most of its life in the water.</p><h2>+Diet</h2><ul><li>+Sea urchins, which it opens with a stone</li><li>+Crabs and clams</li></ul></div></div>
<div id="mw-navigation"><ul><li><a href=/>Main page</a></li><li><a href=/r>Random article</a></li><li><a href=/t>Talk</a></li></ul></div>
<div id="footer"><ul><li>This page was last edited on 4 March 2021.</li><li><a href=/p>Privacy policy</a></li></ul></div></body></html>""",
    "chinese news": """<html><body><div class="hd"><a href=/>首页</a> <a href=/n>新闻</a> <a href=/s>体育</a></div><div class="bd"><h1>+新桥今日通车</h1><p>+经过三年的施工，横跨长江的大桥于今天上午正式通车，首批车辆顺利通过。</p><p>+市民表示，新桥将把上班时间缩短一半，周边的居民也会因此受益。</p></div><div class="ft">版权所有 某某新闻网</div></body></html>""",
    "hashed names": """<!doctype html><html><body><header><a href=/>The Daily</a><nav><a href=/w>World</a><a href=/b>Business</a></nav></header><main><div class="css-1x2"><h1>+Rain ends the long drought</h1><p>+Farmers in the south welcomed two days of steady rain, the first since April.</p><p>+Reservoirs remain low, officials said, and limits on watering will stay in place until the autumn.</p></div></main><footer>© 2023 The Daily</footer></body></html>""",
    "nineties": """<html><body bgcolor=white><table width="100%"><tr><td colspan=2><font size=6>My Home Page</font></td></tr><tr><td width=120><a href=i.html>Home</a><br><a href=n.html>News</a><br><a href=l.html>Links</a></td><td><font face=arial><h2>+How to brew coffee</h2><p>+Heat the water until it almost boils, then wait for half a minute before you pour it over the grounds.<p>+Let it stand for four minutes. Press slowly and serve at once.</font></td></tr></table><hr><center>Copyright 1998</center></body></html>""",
    "letter": """<html><body><p>+Dear Anna,<p>+thank you for the parcel, which reached us on Friday in good order. The children have already eaten the chocolate.<p>+We hope to visit you in spring, when the roads are dry again.<p>+Yours,<p>+Martha</body></html>""",
    "letter without tags": "+Dear Sir, I write to you about the fence between our gardens. It fell in the storm last week. I would gladly share the cost of a new one. With kind regards, T. Miller",
    "formula": """<html><body><article><h1>+Solving equations</h1><p>+Take a line <math><mi>y</mi><mo>=</mo><mn>2</mn><mi>x</mi></math> and find where it meets the axis.</p><p>+It does so at the origin, as one sees by setting both sides to zero.</p></article><aside><h3>Related articles</h3><ul><li><a href=/a>Circles</a></li></ul></aside></body></html>""",
    "blog": """<html><body><div id=header><h1><a href=/>Notes from a garden</a></h1><p>A diary of weeds</p></div><div id=wrapper><div id=left><h2>+Slugs again</h2><p>+They came in the night and ate every lettuce. I counted forty of them at dawn, all of them fat and happy.</p><p>+Beer traps have worked before, so I set out six.</p><blockquote><p>+A garden is a grand teacher.</p></blockquote></div><div id=right><h4>Recent posts</h4><ul><li><a href=/1>Moles</a></li><li><a href=/2>Frost in May</a></li></ul><h4>Categories</h4><ul><li><a href=/c>Pests</a></li></ul></div></div><div id=comments><h3>2 comments</h3><div><b>Jo says:</b><p>Try copper tape, it worked for me.</p></div><div><b>Ed says:</b><p>Ducks!</p></div></div><div id=footer>Powered by Press</div></body></html>""",
    "german paper": """<html><body><div class="x9">Wir verwenden Cookies, um Inhalte zu personalisieren. <button>Alle akzeptieren</button></div><ul class="x1"><li><a href=/p>Politik</a><li><a href=/w>Wirtschaft</a><li><a href=/s>Sport</a></ul><div class="x2"><div class="x3"><h1>+Stadt baut neue Radwege</h1><div>+Von Maria Huber</div><p>+Der Rat hat am Dienstag beschlossen, in den nächsten zwei Jahren zwölf Kilometer Radwege zu bauen. Die Kosten trägt zur Hälfte das Land.</p><p>+Anwohner hatten seit Langem darauf gedrängt, weil die Straßen als gefährlich gelten.</p></div><div class="x4"><h3>Meistgelesen</h3><ol><li><a href=/1>Brücke gesperrt</a><li><a href=/2>Fest am Fluss</a></ol></div></div><div class="x5">Alle Rechte vorbehalten. <a href=/i>Impressum</a></div></body></html>""",
    "recipe": """<html><body><nav><a href=/>Home</a> | <a href=/r>Recipes</a></nav><section><h1>+Lentil soup</h1><p>+A warm soup for cold evenings, ready in forty minutes.</p><h2>+Ingredients</h2><ul><li>+200 g red lentils</li><li>+1 onion</li><li>+2 carrots</li><li>+1 l stock</li></ul><h2>+Method</h2><ol><li>+Chop the onion and the carrots and fry them gently in oil.</li><li>+Add lentils and stock and simmer for half an hour.</li></ol></section><form><label>Subscribe to our newsletter</label><input name=e><button>Send</button></form><footer><p>All rights reserved.</p></footer></body></html>""",
    "french": """<html><body><div><a href=/>Accueil</a> <a href=/a>Actualités</a> <a href=/c>Contact</a></div><div><div><h1>+Le marché rouvre ses portes</h1><p>+Après deux ans de travaux, le vieux marché couvert accueille de nouveau ses marchands depuis samedi.</p><p>+Les habitants du quartier, venus en nombre, ont salué la lumière et les nouvelles allées.</p></div></div><div>Tous droits réservés. <a href=/m>Mentions légales</a></div></body></html>""",
    "russian": """<html><body><div class=m><a href=/>Главная</a><a href=/n>Новости</a><a href=/k>Контакты</a></div><div class=t><h1>+Музей открыл новый зал</h1><p>+В субботу городской музей показал собрание старых карт, которое долго хранилось в запасниках.</p><p>+Вход для школьников будет свободным до конца месяца.</p></div><div class=f>Все права защищены.</div></body></html>""",
    "japanese": """<html><body><ul><li><a href=/>ホーム</a></li><li><a href=/n>ニュース</a></li></ul><div><h1>+桜が咲きました</h1><p>+今年は例年より一週間早く、公園の桜が満開になりました。多くの人が花見を楽しんでいます。</p><p>+夜は明かりがともり、十時まで入ることができます。</p></div><div><h3>関連記事</h3><a href=/1>春の祭り</a></div></body></html>""",
    "documentation": """<html><body><div class="sidebar"><ul><li><a href=a>Install</a></li><li><a href=b>Tutorial</a></li><li><a href=c>Reference</a></li></ul></div><div class="document"><div class="section"><h1>+Reading files</h1><p>+Call <code>open_table</code> with a path to read a table. It returns an object whose rows can be read in order.</p><pre>+t = open_table("a.csv")
for row in t: show(row)</pre><p>+Close the table when you are done, or use it in a block that closes it.</p><table><tr><th>+Option</th><th>+Meaning</th></tr><tr><td>+sep</td><td>+The sign between fields</td></tr></table></div></div><div class="footer">Copyright 2020 | <a href=s>Page source</a></div></body></html>""",
    "story in breaks": """<html><body><center><h1>+The Fox and the Mill</h1></center><font size=3>+Once a fox lived under a mill. Every night it stole flour and every morning it left white tracks across the yard.<br><br>The miller followed them into the wood, and there he found the cubs.</font></body></html>""",
    "company": """<html><body><div class="topbar"><a href=/>Acme Pumps</a> <a href=/p>Products</a> <a href=/c>Contact</a></div><div class="hero"><h1>+Pumps that last</h1><p>+We have built pumps for wells and mines since 1921, and every one of them leaves our works tested.</p></div><div class="row"><div class="col"><h3>+Service</h3><p>+Our fitters come within two days, wherever the pump stands.</p></div><div class="col"><h3>+Parts</h3><p>+All parts are kept in stock for thirty years after the last sale.</p></div></div><div class="bottom">© 2022 Acme Pumps. All rights reserved.</div></body></html>""",
    "notice and scripts off": """<html><body><noscript>Please enable JavaScript to use this site.</noscript><div role=dialog>We use cookies to improve your experience. <button>Accept all cookies</button></div><main><article><h1>+Owls of the valley</h1><p>+Three kinds of owl nest in the valley, and all of them hunt along the river.</p><video src=v>+A film of the barn owl in flight.</video><p>+The smallest weighs no more than a letter.</p></article></main></body></html>""",
    "spanish": """<html><body><header><div>El Faro</div></header><div class="c-1f"><div class="c-2a"><h1>+La cosecha llega tarde</h1><p>+Los agricultores de la comarca esperan recoger la aceituna con un mes de retraso por culpa de las lluvias.</p><p>+El precio del aceite, según la cooperativa, subirá en invierno.</p></div><div class="c-9b"><p>Artículos relacionados</p><a href=/1>El precio del trigo</a></div></div><div class="c-77"><h3>Comentarios</h3><p>Juan dice:</p><p>Aquí pasa lo mismo.</p></div></body></html>""",
    "question and answer": """<html><body><div id=nav><a href=/>Home</a> <a href=/q>Questions</a></div><div id=q><h1>+Why is my bread flat?</h1><div>+I let the dough rise for an hour, but it falls when I put it in the oven. The yeast is fresh.</div></div><div id=a><div>+It has risen too long. Put it in the oven before it is twice its size, and make sure that the oven is hot.</div></div><div id=foot><a href=/t>Terms of use</a> <a href=/p>Privacy policy</a></div></body></html>""",
    "sponsored": """<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><div class=ad><a href=/x>Advertisement: buy two lamps and pay for one</a></div><div class=post-content><h2>+Mending a lamp</h2><p>+Unplug the lamp first. Then open the base and look for a loose wire.</p><p>+If the wire is sound, the switch is the next thing to test.</p></div><div class=sponsored><p>Sponsored</p><a href=/y>Ten lamps you will love</a></div><ul class=share><li><a href=/f>Share on Facebook</a></li><li><a href=/t>Tweet</a></li></ul></body></html>""",
}


def labelled(page: str):
    """The page without the marks, the texts of its blocks and which of them are the article's."""
    from foliospark.llm.html_blocks import blocks

    found = blocks(page)
    return page.replace("+", ""), [(b.text.replace("+", ""), "+" in b.text) for b in found]
