"""Small pages labelled by hand: ``data-content`` says whether what an element encloses is main text or apart from it."""

PAGES = [
    """<body><header class="site-header"><a href="/">Daily News</a><ul class="menu"><li><a href="/a">World</a></li>
    <li><a href="/b">Sport</a></li></ul></header><div class="content" data-content="1"><h1>Rain expected</h1>
    <p>Heavy rain is expected on Friday. Rivers may rise.</p><p>Stay at home.</p><ul><li>Close the windows.</li>
    <li>Keep dry, and <a href="/x">read on</a>.</li></ul><div class="share" data-content="0"><a href="/t">Share</a></div></div>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A storm comes</a></li></ul><p>Written by our staff.</p></aside>
    <footer class="footer"><p>Copyright 2020. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body>""",
    """<body><div id="cookie-notice"><p>We use cookies to improve this site. By going on you agree.</p><button>OK</button></div>
    <nav class="navbar"><a href="/">Home</a><a href="/shop">Shop</a></nav><main data-content="1"><section><h2>How to bake</h2>
    <p>Mix the flour with water and let it rest for an hour, then knead it well until it is smooth. Bake for forty minutes.</p>
    <blockquote>Bread is life.</blockquote><table><tr><th>Flour</th><td>500 g</td></tr></table></section>
    <div class="advertisement" data-content="0"><p>Buy the best oven now! Only this week.</p></div>
    <section id="comments" class="comments" data-content="0"><h3>Comments</h3><div class="comment"><p>Great recipe, thank you! I made
    it twice and my family loved it.</p></div><form><label>Your comment</label><p>Please be kind.</p></form></section></main>
    <div class="footer"><ul><li><a href="/c">Contact</a></li></ul><p>Made with care in town.</p></div></body>""",
    """<body><div class="top" data-content="0"><a href="/">Blog</a> <a href="/about">About</a></div><article data-content="1"><h1>On walking</h1>
    <p>A walk a day.</p><p>Walking is the simplest way to travel. It needs no ticket, and it shows more of a place.</p>
    <figure><figcaption>A path near the lake.</figcaption></figure><p>Begin slowly.</p></article>
    <div class="related"><h4>Related</h4><a href="/r1">On running</a><a href="/r2">On sitting</a></div>
    <form action="/search"><p>Search this site</p></form><footer><small>&copy; Blog</small></footer></body>""",
    """<body><table><tr><td class="menu"><a href="/1">One</a><br><a href="/2">Two</a></td><td data-content="1"><h2>Old page</h2>
    <p>This page was written long ago. It still holds.</p><p>It has a few paragraphs of plain text, none of which has a class, and
    they go on for a while so that there is something to read.</p></td></tr></table>
    <div class="banner-ad">Cheap flights to anywhere. Click here.</div><div id="footer">Last changed in 1999.</div></body>""",
    """<body><div class="wrapper"><div class="alert notice">The library is closed on Monday.</div><div class="main-text" data-content="1">
    <h1>Opening hours</h1><p>The library opens at nine.</p><dl><dt>Monday</dt><dd>Closed.</dd><dt>Tuesday</dt><dd>Nine to five.</dd></dl>
    <pre>9 - 17</pre></div><div class="newsletter"><p>Get our letter every week. It is free.</p></div></div></body>""",
    """<body><ul class="breadcrumbs"><li><a href="/">Start</a></li><li>Here</li></ul><div data-content="1"><p>A page may have no class at
    all around its text. Then length and full sentences tell that it is what a reader came for, and so it should stay in.</p>
    <p>Even this one.</p></div><div data-content="0"><a href="/p">Previous</a> <a href="/n">Next</a></div><p data-content="0"><a href="/all">All pages</a></p></body>""",
]
