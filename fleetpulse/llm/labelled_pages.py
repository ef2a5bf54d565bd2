"""Small labelled pages to train the extractor on.

Plain markup in which an attribute `keep` marks the elements whose text is main text. {p} stands for a paragraph, {s}
for a short sentence, {w} for one to four words; training fills them in with made-up words.
"""

PAGES = [
    '<nav><ul><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li></ul></nav>'
    '<div class="ad">{s}</div><article keep><h1>{s}</h1><p>{p}</p><p>{s}</p><p>{p}</p></article><footer>{s}</footer>',
    '<div class="ad">{p}</div><nav><ul><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li></ul></nav>'
    '<article keep><h1>{s}</h1><p><b>{s}<br><p>{w}.</p><p>{p}</p><p>{w}.</p><p>{p}</p></article><footer>{p}</footer>',
    '<header class="site-header"><a href="#">{w}</a><p>{w}</p></header><div id="menu"><a href="#">{w}</a> <a href="#">{w}</a></div>'
    '<div id="content"><h1 keep>{s}</h1><p keep>{p}</p><h2 keep>{w}</h2><p keep>{p}</p><ul><li keep>{s}</li><li keep>{s}</li></ul></div>'
    '<div class="sidebar"><h3>{w}</h3><ul><li><a href="#">{s}</a></li><li><a href="#">{s}</a></li></ul><p>{s}</p></div>'
    '<div id="footer"><p>{s}</p><a href="#">{w}</a></div>',
    '<div class="cookie-notice"><p>{p}</p><button>{w}</button></div><header><h2>{w}</h2><nav><a href="#">{w}</a></nav></header>'
    '<main><article keep><h1>{s}</h1><p>{p}</p><blockquote>{p}</blockquote><p>{p}</p></article>'
    '<section class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p></div></section></main>'
    '<aside><h3>{w}</h3><p>{p}</p><a href="#">{s}</a></aside><footer><p>{p}</p></footer>',
    '<div class="topbar"><span>{w}</span></div><div class="banner">{s}</div><div class="post-content"><h1 keep>{s}</h1><p keep>{p}</p>'
    '<div class="advert"><p>{p}</p></div><p keep>{p}</p><table><tr><td keep>{w}</td><td keep>{w}</td></tr></table><p keep>{s}</p></div>'
    '<form action="#"><label>{w}</label><input><p>{s}</p><button>{w}</button></form><ol id="comments"><li><p>{p}</p></li><li><p>{s}</p></li></ol>'
    '<div class="footer-links"><a href="#">{w}</a><a href="#">{w}</a></div>',
    '<div class="notice">{p}</div><div role="navigation"><a href="#">{w}</a><a href="#">{w}</a></div>'
    '<div class="entry" keep><h1>{s}</h1><div>{p}</div><div>{p}</div><pre>{s}</pre></div><div class="related"><h4>{w}</h4><a href="#">{s}</a>'
    '<a href="#">{s}</a></div><div class="newsletter"><p>{s}</p><form><input><button>{w}</button></form></div><div class="copyright">{s}</div>',
    '<body><p>{w}</p><ul class="menu"><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li></ul><main keep><h1>{s}</h1><p>{p}</p>'
    '<p>{s}</p><ul><li>{s}</li><li>{p}</li></ul><p>{p}</p></main><div class="promo"><p>{p}</p></div><footer><p>{w}</p><p>{s}</p></footer></body>',
    '<div class="breadcrumb"><a href="#">{w}</a><a href="#">{w}</a></div><div class="sponsored ads"><p>{p}</p><a href="#">{s}</a></div>'
    '<article keep><header><h1>{s}</h1></header><section><h2>{w}</h2><p>{p}</p><p>{p} <a href="#">{w}</a> {s}</p></section></article>'
    '<aside class="widget"><p>{p}</p></aside><div class="alert"><p>{s}</p></div><div id="disqus_thread" class="replies"><p>{p}</p><p>{p}</p></div>',
    '<table class="nav"><tr><td><a href="#">{w}</a></td><td><a href="#">{w}</a></td></tr></table><div class="text" keep><p>{p}</p><p>{s}</p><p>{p}</p>'
    '<p>{p}</p></div><div class="share"><span>{w}</span><a href="#">{w}</a></div><div class="user-reviews"><p>{p}</p></div><address>{s}</address>',
    '<div class="popup"><p>{s}</p></div><div class="story"><h1 keep>{w}</h1><h2 keep>{s}</h2><p keep>{p}</p><figure><figcaption keep>{s}</figcaption></figure>'
    '<p keep>{p}</p><div class="ad-slot">{s}</div><p keep>{p}</p><p keep>{s}</p></div><div class="tags"><a href="#">{w}</a><a href="#">{w}</a></div>'
    '<section id="responses"><article><p>{p}</p></article></section><div class="legal"><p>{p}</p></div>',
    '<article><h1 keep>{s}</h1><p keep>{p}</p><aside>{p}</aside><p keep>{p}</p><div class="advert">{p}</div><p keep>{s}</p><p keep>{p}</p>'
    '<nav><a href="#">{w}</a></nav><section class="comments"><p>{p}</p><p>{s}</p></section></article><aside><p>{p}</p></aside>',
    '<main><div class="notice"><p>{p}</p></div><article><h2 keep>{w}</h2><p keep>{p}</p><form><p>{s}</p></form><p keep>{p}</p><aside><p>{s}</p></aside>'
    '<ul><li keep>{s}</li><li keep>{p}</li></ul><footer><p>{s}</p></footer></article><div id="comments"><div>{p}</div><div>{p}</div></div></main>',
]

#: Names that pages give to one kind of element; training puts one for another.
KINDS = [
    "comment comments comment-list user-comments replies responses discussion reader-comments reviews disqus thread",
    "footer footer-links site-footer copyright legal colophon bottom imprint",
    "ad ads advert advertisement sponsored promo banner ad-slot sponsor adbox",
    "sidebar widget related aside side-column recommended more-stories trending right-rail",
    "menu nav navbar navigation breadcrumb topbar main-menu toolbar links pager",
    "header site-header masthead branding page-header top logo",
    "cookie-notice notice alert consent gdpr popup cookie banner-notice message modal warning",
    "newsletter subscribe signup form login search contact share social tags buttons",
    "content post-content entry text story article-body main-content body-text post page-content article",
]
