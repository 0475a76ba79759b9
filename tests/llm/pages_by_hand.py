"""Pages of many kinds, written by hand; § stands before each block that belongs to the article."""

P = [
    "§The river froze twice that winter, and both times the ferry stayed on the far bank until the thaw.",
    "§Nobody in the village could remember a longer frost, although the parish book tells of one in 1740.",
    "§Bread was carried over the ice on sledges. Children earned a penny for each loaf that arrived dry.",
    "§When the first crack was heard, at four in the morning, the bell rang and everyone ran to the shore.",
    "§It took nine days to clear the channel; the mill, which had stood idle, began to turn on the tenth.",
]
A, B, C, D, E = P
ps = "".join(f"<p>{x}</p>" for x in P)
T = "§The winter of the two frosts"

PAGES = {
    "blog post of a common CMS": f"""<body class="single single-post postid-12"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">River Notes</a></p><p class="site-description">Stories from the bank</p></header><nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post status-publish hentry"><header class="entry-header"><h1 class="entry-title">{T}</h1></header><div class="entry-content"><p>{A}</p><p>{B}</p><h2>§What was eaten</h2><ul><li>§Bread and salted herring</li><li>§Turnips, when there were any</li></ul><p>{C}</p></div></article></main></div><aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">The mill</a></li><li><a href="/b">The ferry</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by WordPress</div></footer></div>""",
    "long divisions without meaning": f"<body><div class=x2>{A} {B}</div><div class=x2>{C} {D}</div><div class=x2>{E} {A[1:]}</div>",
    "wiki with a list of contents": f"""<body class="mediawiki"><div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">{T}</h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output"><p>{A}</p><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#h">1 History</a></li><li><a href="#m">2 The mill</a></li></ul></div><h2>§History</h2><p>{B}</p><p>{D}</p><h2>§The mill</h2><p>{E}</p></div></div></div></div><div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div><footer id="footer" class="mw-footer"><ul><li>This page was last edited in May.</li><li><a href="/p">Privacy policy</a></li></ul></footer>""",
    "bare article": f"<article><h1>{T}</h1>{ps}</article>",
    "main without article": f"<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><main><h1>{T}</h1>{ps}</main><footer>© 2023 Example</footer>",
    "no markup but paragraphs": f"<h1>{T}</h1>{ps}",
    "old table layout": f"<body bgcolor=white><table width=100%><tr><td width=150 class=menu><a href=a>Home</a><br><a href=b>Links</a></td><td><h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table><div class=footer>Copyright 1999 by the webmaster</div>",
    "news story": f"""<body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept all</button></div><header class="masthead"><a href="/">The Daily Bank</a></header><nav class="navbar"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav><div class="story"><h1 class="headline">{T}</h1><div class="story-body"><p>{A}</p><div class="ad">Advertisement: buy skates now</div><p>{B}</p><p>{C}</p></div></div><div class="related"><h3>Related stories</h3><ul><li><a href="/1">Ferry sold</a></li><li><a href="/2">Ice sold</a></li></ul></div><footer><p>© The Daily Bank. All rights reserved.</p></footer>""",
    "reader comments": f"""<article><h1>{T}</h1><p>{A}</p><p>{B}</p></article><section id="comments" class="comments-area"><h2>3 comments</h2><div class="comment"><p>Great post, my grandmother told me about this.</p></div><div class="comment"><p>I do not believe the part about the herring.</p></div></section>""",
    "comments in list": f"""<div class="post"><h2>{T}</h2><div class="post-content"><p>{C}</p><p>{D}</p></div></div><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Thanks for writing this down.</p></div></li><li class="comment"><div class="comment-body"><p>First!</p></div></li></ol>""",
    "documentation": f"""<body><nav class="sidebar"><ul><li><a href="/i">Install</a></li><li><a href="/u">Usage</a></li><li><a href="/f">FAQ</a></li></ul></nav><main role="main"><h1>§Clearing a frozen channel</h1><p>{A}</p><pre><code>§saw --length 9 --depth 2</code></pre><p>{E}</p><h2>§Options</h2><ul><li>§length: how far the blade reaches</li><li>§depth: how thick the ice may be</li></ul></main>""",
    "recipe": f"""<header class="site-header"><a href="/">Winter Kitchen</a></header><article class="recipe"><h1>§Ferry bread</h1><p>{C}</p><h2>§Ingredients</h2><ul><li>§500 g of rye flour</li><li>§a cup of sour milk</li><li>§salt</li></ul><h2>§Method</h2><ol><li>§Mix the flour and the milk and leave them for a night.</li><li>§Bake for an hour in a hot oven.</li></ol></article><form class="newsletter"><label>Your email</label><button>Subscribe</button></form>""",
    "deep wrappers": "<body>" + "".join(f"<div class='w{i}k'>" for i in range(9)) + f"<div class='content'><h1>{T}</h1>{ps}</div>" + "</div>" * 9 + "<footer class='site-footer'><p>Imprint and privacy</p></footer>",
    "atomic class names": f"""<div class="css-1a2b3c"><div class="css-zz91"><nav class="css-77q"><a href="/">Home</a><a href="/x">Topics</a></nav><main class="css-0p"><h1 class="css-5t">{T}</h1><div class="css-9k"><p class="css-8m">{A}</p><p class="css-8m">{B}</p><p class="css-8m">{D}</p></div></main><footer class="css-3u"><p class="css-4">© 2024 Example Inc.</p></footer></div></div>""",
    "utility class names": f"""<div class="flex flex-col min-h-screen"><header class="bg-white shadow p-4"><a class="font-bold" href="/">Bank Journal</a></header><main class="max-w-prose mx-auto px-4"><h1 class="text-3xl mb-4">{T}</h1><p class="mb-4">{A}</p><p class="mb-4">{B}</p><p class="mb-4">{E}</p></main><footer class="mt-8 text-sm"><p>© Bank Journal</p></footer></div>""",
    "question and answer text": f"""<main id="content"><h1>§Why did the ferry stay on the far bank?</h1><div class="article-body"><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{D}</p></div></main><aside class="sidebar"><h4>Popular</h4><ul><li><a href="/q">Why is ice slippery</a></li></ul></aside>""",
    "magazine with figure": f"""<article><header><h1>{T}</h1></header><figure><img src="a.jpg"><figcaption>§The ferry in the ice, drawn by the miller.</figcaption></figure><p>{A}</p><p>{B}</p></article><div class="share-buttons"><a href="/t">Tweet</a><a href="/f">Share</a></div>""",
    "paywall notice": f"""<main><article class="post"><h1>{T}</h1><p>{A}</p><p>{C}</p></article></main><div class="paywall"><p>Subscribe now to keep reading our stories.</p><button>Sign in</button></div>""",
    "advert inside": f"""<div class="entry-content"><h1>{T}</h1><p>{A}</p><div class="ad-slot"><p>Sponsored: cheap skates at the shop</p></div><p>{B}</p><aside class="promo"><a href="/p">Sale ends today, buy now</a></aside><p>{C}</p></div>""",
    "forum-like page": f"""<nav class="breadcrumbs"><a href="/">Index</a> <a href="/h">History</a></nav><div class="content"><h1>{T}</h1><p>{B}</p><p>{C}</p></div><div class="pagination"><a href="?2">2</a><a href="?3">Next</a></div><footer>Terms of use</footer>""",
    "unclosed paragraphs": f"<body><div id=header><a href=/>Home page</a></div><div id=content><h1>{T}</h1><p>{A}<p>{B}<p>{C}<p>{D}</div><div id=footer>Copyright, all rights reserved</div>",
    "upper-case tags": f"<BODY><DIV CLASS=NAV><A HREF=/>Home</A> <A HREF=/n>News</A></DIV><DIV CLASS=CONTENT><H1>{T}</H1><P>{A}</P><P>{E}</P></DIV><DIV CLASS=FOOTER>© 2001</DIV></BODY>",
    "sections": f"<main><section><h2>{T}</h2><p>{A}</p><p>{B}</p></section><section><h2>§After the thaw</h2><p>{D}</p><p>{E}</p></section></main><footer class='page-footer'><p>All rights reserved</p></footer>",
    "data table": f"<article><h1>§Days of frost</h1><p>{B}</p><table><tr><th>§Year</th><th>§Days</th></tr><tr><td>§1740</td><td>§71</td></tr><tr><td>§1812</td><td>§63</td></tr></table><p>{E}</p></article><nav><a href='/'>Home</a></nav>",
    "search form and login": f"""<form class="search"><label>Search</label><input name=q><button>Go</button></form><form id="login"><p>User name and password</p><button>Log in</button></form><div id="main-content"><h1>{T}</h1><p>{A}</p><p>{B}</p></div>""",
    "Greek page": "<nav><a href='/'>Αρχική</a><a href='/n'>Νέα</a></nav><article><h1>§Ο χειμώνας στο χωριό</h1><p>§Το ποτάμι πάγωσε δύο φορές εκείνο τον χειμώνα και το πλοίο έμεινε στην άλλη όχθη.</p><p>§Κανείς δεν θυμόταν τόσο μεγάλο κρύο, αν και το βιβλίο γράφει για ένα παλιότερο.</p></article><footer>© Το χωριό</footer>",
    "Russian page": "<div class='menu'><a href='/'>Главная</a><a href='/n'>Новости</a></div><div class='article-body'><h1>§Зима в деревне</h1><p>§Река замёрзла дважды за ту зиму, и паром стоял у дальнего берега до самой оттепели.</p><p>§Хлеб возили по льду на санях, а дети получали за это деньги.</p></div><div class='footer'>Все права защищены</div>",
    "Chinese page": "<nav><ul><li><a href='/'>首页</a></li><li><a href='/n'>新闻</a></li></ul></nav><article><h1>§河边的冬天</h1><p>§那年冬天河水结冰两次，渡船一直停在对岸，直到冰雪融化。</p><p>§村里没有人记得有过更长的严寒。</p></article><footer><p>版权所有</p></footer>",
    "interview": f"<main><article><h1>§“We heard it crack”</h1><p><strong>§How long did it take?</strong></p><p>{E}</p><p><strong>§And the children?</strong></p><p>{C}</p></article></main><div class='widget'><h3>Most read</h3><ol><li><a href='/1'>Ice fair</a></li></ol></div>",
    "glossary": "<header class='site-header'><a href='/'>Ice Terms</a></header><main><h1>§Words for ice</h1><dl><dt>§Brash</dt><dd>§Small broken pieces that float near the shore.</dd><dt>§Floe</dt><dd>§A flat sheet that has come away from the rest.</dd></dl></main><footer>Contact us</footer>",
    "product notice bar": f"<div class='notice'>Our office is closed on Monday.</div><div class='container'><div class='row'><div class='col-8 post-content'><h1>{T}</h1><p>{A}</p><p>{B}</p></div><div class='col-4 sidebar'><h3>Tags</h3><ul><li><a href='/i'>ice</a></li><li><a href='/f'>ferry</a></li></ul></div></div></div>",
    "nested lists": f"<article><h1>§What to bring</h1><p>{A}</p><ul><li>§A sledge<ul><li>§with a rope</li><li>§with iron runners</li></ul></li><li>§Warm gloves</li></ul></article><aside><p>Read more about sledges in our shop</p></aside>",
    "short note": "<nav><a href=/>Home</a></nav><article><h1>§Ferry closed</h1><p>§The ferry is closed today because of ice.</p></article><footer>© Ferry office</footer>",
    "letter": f"<div class='page'><div class='text'><p>§Dear sister,</p><p>{A}</p><p>{B}</p><p>§Your brother, Tom</p></div></div><div class='copyright'>© Letters Archive</div>",
}
