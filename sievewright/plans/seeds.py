"""Seeds: the test tables hold next to nothing of what the operators look for, so queries plant it,
by the same expression on either engine."""

from __future__ import annotations

TEXT = (
    "CASE doc_id % 10 WHEN 0 THEN replace(text, ' the ', ' the\u200b ') WHEN 1 THEN replace(text, ' and ', '\u00a0and\u2009')"
    " WHEN 2 THEN replace(text, 'th', 'th\u00ad') WHEN 3 THEN replace(replace(text, 'é', 'é\u200d'), 't', 't\u200d')"
    " WHEN 4 THEN replace(text, '. ', '.\u202e ') WHEN 5 THEN replace(text, 'on', 'on\ue000')"
    " WHEN 6 THEN replace(text, '.', '1\U000e0041.\U000e0042') WHEN 7 THEN replace(text, ' as ', ' \u0430s ')"
    " WHEN 8 THEN concat(text, ' \u2764\ufe0f\u200d\U0001f525 \u0890') ELSE text END"
)
MARKERS = (
    "concat(text, CASE doc_id % 8 WHEN 0 THEN ' digitalSourceType trainedAlgorithmicMedia' WHEN 1 THEN ' GPSLatitude 1' WHEN 2 THEN ' SerialNumber 7'"
    " WHEN 3 THEN ' dc:creator' WHEN 4 THEN ' xmp:CreateDate' WHEN 5 THEN ' Midjourney' WHEN 6 THEN ' jumb c2pa' ELSE '' END)"
)
PHRASES = (
    "concat(text, CASE doc_id % 7 WHEN 0 THEN ' Let us delve into the rich tapestry of it.' WHEN 1 THEN ' Moreover, it plays a crucial role.'"
    " WHEN 2 THEN ' As an AI, in conclusion, I hope this helps.' WHEN 3 THEN ' A testament to a myriad of holistic views.'"
    " WHEN 4 THEN ' In today''s digital world, ultimately, we harness the power of it.' ELSE '' END)"
)
HTML = (
    "replace(replace(html, '<meta charset=\"utf-8\">', concat('<meta charset=\"utf-8\">', CASE page_id % 6 WHEN 0 THEN '<meta name=\"generator\" content=\"SitePress 6\">'"
    " WHEN 1 THEN '<meta name=\"generator\" content=\"ChatGPT\">' WHEN 2 THEN '<meta name=\"author\" content=\"A. Writer\">'"
    " WHEN 3 THEN '<script type=\"application/ld+json\">{\"a\": \"trainedAlgorithmicMedia\"}</script>' WHEN 4 THEN '<meta property=\"c2pa\" content=\"x\">' ELSE '' END)),"
    " '<article>', CASE WHEN page_id % 4 = 0 THEN '<article data-ai-model=\"m\">' ELSE '<article>' END)"
)
FRONT = (
    "concat('---\ntitle: x\nauthor: y\n', CASE doc_id % 5 WHEN 0 THEN 'generator: z\n  nested: 1\n' WHEN 1 THEN 'model: q\n  - a\n\n# note\n'"
    " WHEN 2 THEN 'tags: ai-generated\n' WHEN 3 THEN 'date: 2020\n' ELSE '' END, '---\n', text)"
)
SVG = (
    "concat('<svg xmlns=\"s\"', CASE page_id % 4 WHEN 0 THEN ' inkscape:version=\"1.0\"' ELSE '' END, '>', CASE page_id % 3 WHEN 0 THEN '<metadata><dc:creator>n</dc:creator></metadata>'"
    " WHEN 1 THEN '<!-- by Midjourney --><!-- plain -->' ELSE '<?xpacket a?><x:xmpmeta>c2pa</x:xmpmeta>' END, '<g/></svg>')"
)
SITEMAP = "concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url><url><LOC>http://b.example/?a=1&amp;b=2</LOC></url><loc> </loc></urlset>')"
ADDRESS = "concat_ws('.', CAST(user_id % 256 AS VARCHAR(9)), CAST(event_id % 256 AS VARCHAR(9)), CAST(user_id % 7 AS VARCHAR(9)), '1')"
