"""Marked pages that the block classifier of `html_extract` is trained on: the text of each block starts with + (content) or - (boilerplate)."""

_LONG = "The council met on Tuesday to discuss the plan for the old harbour, and after three hours it agreed on a first draft that will be open to the public for six weeks."
_MORE = "Residents had asked for a quiet promenade with trees; the builders had asked for parking. The draft has both, though neither side got quite what it wanted from the talks."
_SHORT = "Nobody disagreed in the end."

PAGES = (
    f"""<html><body><header><h1>- The Daily Port</h1><p>- News from the coast since 1911.</p></header><nav><ul><li><a>- Home</a><li><a>- Sports</a><li><a>- Weather and tides</a></ul></nav>
    <article><h1>+ A plan for the harbour</h1><p>+ {_LONG}</p><p>+ {_MORE}</p><h2>+ What comes next</h2><p>+ {_SHORT}</p><ul><li>+ A hearing in May</li><li>+ A vote in June.</li></ul></article>
    <aside><p>- Read also: how the lighthouse was saved by a group of volunteers over ten long summers.</p></aside><footer><p>- All rights reserved. No part of this site may be copied without written consent of the publisher, whose address is given in the imprint.</p><p>- &copy; 2020</p></footer></body></html>""",
    f"""<html><body><div id="header"><div class="logo">- Port Weekly</div><div class="menu"><a>- Start</a> <a>Contact</a></div></div><div class="ad">- Buy two nets and get a third one for free this week only.</div>
    <div class="content"><h1>+ The harbour again</h1><p>+ {_MORE}</p><p>+ {_SHORT}</p><blockquote>+ We shall see.</blockquote><p>+ {_LONG}</p></div>
    <div class="sidebar"><h3>- Most read</h3><ul><li><a>- Ten boats you should know</a></li><li><a>- The storm of the century in pictures</a></li></ul><p>- Our newsletter brings you the news of the coast every Friday, and it costs you nothing at all.</p></div>
    <div class="site-footer"><p>- Imprint and terms. We use cookies to make this site better for you and for the people who pay for it.</p></div></body></html>""",
    f"""<body><div class="cookie-notice"><p>- This site uses cookies. By going on you agree to our terms of use and to our privacy policy, which we changed last month for your benefit.</p><button>- Accept</button></div>
    <main><h1>+ Notes on nets</h1><p>+ {_LONG}</p><figure><figcaption>+ The old net loft</figcaption></figure><p>+ {_MORE}</p><form><label>- Your mail</label><p>- Subscribe to get the next part by mail before all others can read it.</p><button>- Go</button></form></main>
    <section id="comments"><h2>- 3 comments</h2><article class="comment"><p>- I was there and it was nothing like that at all; the talks were short, the coffee was cold and nobody asked us a thing about the trees.</p><a class="reply">- Reply</a></article>
    <article class="comment"><p>- Well said!</p></article></section></body>""",
    f"""<body><div class="wrap"><p>+ {_LONG}</p><p>+ {_SHORT}</p><p>+ {_MORE}</p></div><div class="share-buttons"><a>- Tweet</a> <a>Mail</a></div><div class="related-posts"><h3>- More like this</h3><p>- A walk along the quay with the last of the pilots, who tells how it was before the bridge.</p></div></body>""",
    f"""<body><nav>- You are here: coast, harbour, plans</nav><article class="story with-rail"><header><h1>+ Trees on the quay</h1><p>+ By our own reporter</p></header><div class="entry"><p>+ {_MORE}</p><table><tr><td>+ Oaks</td><td>+ 14</td></tr><tr><td>+ Limes</td><td>+ 9</td></tr></table><p>+ {_LONG}</p></div>
    <div class="ad-slot">- Sponsored: the best paint for your hull, tested by those who have to scrape it off again.</div><p>+ {_SHORT}</p><div class="tags">- harbour, trees</div><footer>- Posted in news by admin</footer></article></body>""",
    f"""<body><main class="entry social-housing"><h1>+ Who pays for the quay?</h1><p>+ {_LONG}</p><p>+ {_MORE}</p><p>+ {_SHORT}</p></main><div role="contentinfo">- Contact us at the old customs house, second floor, on weekdays from nine to noon.</div></body>""",
    f"""<body><div class="text alert-levels"><h2>+ From the board</h2><p>+ {_LONG}</p><p>+ {_MORE}</p></div><div class="notice">- Your browser is out of date. Please update it to see this page as it was meant to be seen by its makers.</div><ul class="pagination"><li><a>- 1</a></li><li><a>- 2</a></li><li><a>- Next</a></li></ul></body>""",
    f"""<body><table><tr><td><a>- Index</a><td><a>- Links</a></table><h1>+ My page on knots</h1>+ {_LONG}<br>+ {_SHORT}<p>+ {_MORE}<dl><dt>+ Bowline<dd>+ A loop that does not slip.</dl><div class="widget"><p>- You are visitor number 4711.</p></div><div class="copyright">- 1998 by the author</div></body>""",
    f"""<body><article><h1>+ Tides</h1><p>+ {_SHORT}</p><p>+ No.</p><p>+ {_LONG}</p><aside>- Tide tables are sold at the kiosk, where you can also rent a chair for the day.</aside><p>+ {_MORE}</p><div class="newsletter"><p>- Get our letter. One mail a week, no more, and you can leave whenever you like with one click.</p></div></article>
    <div class="comment-list"><div class="comment-body"><p>- Thank you for this piece, I have been looking for such a clear account of the matter for many years and will show it to my class.</p></div></div></body>""",
    f"""<body><div class="chapter-head"><h2>+ Spring in the port</h2></div><div><p>+ {_MORE}</p><p>+ {_LONG}</p></div><div class="chapter-head"><h2>+ Autumn</h2></div><div><p>+ {_LONG}</p></div><div class="login">- Sign in to read on without adverts for as long as you are a member of our club.</div></body>""",
)
