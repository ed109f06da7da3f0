"""Marker vocabularies, and SQL over a lower-cased ASCII view of a text."""

from __future__ import annotations

C2PA = "c2ma c2pa cai: contentauth contentcredentials jumb".split()
PROVENANCE = "aigc|algorithmicmedia|ai generated|ai-generated|c2pa|compositewithtrainedalgorithmicmedia|contentcredentials|dall-e|dcterms:provenance|digitalsourcetype|firefly|generated by|midjourney|stable diffusion|synthid|trainedalgorithmicmedia".split("|")
CLAIMS = "c2pa compositewithtrainedalgorithmicmedia contentcredentials digitalsourcetype trainedalgorithmicmedia".split()
PRIVACY = {
    "location": "<gps exif:gps geo:lat gpsaltitude gpscoordinates gpslatitude gpslongitude gpsposition".split(),
    "device": "bodyserialnumber cameraserial exif:lensmodel hostcomputer internalserialnumber lensserialnumber serialnumber tiff:make tiff:model".split(),
    "author": "artist copyright dc:creator iptc:by-line lastmodifiedby ownername photoshop:author photoshop:credit rights xmp:creatortool".split(),
    "timestamps": "createdate datetimeoriginal dcterms:created gpsdatestamp modifydate xmp:createdate xmp:modifydate".split(),
}
AI_KEYS = "ai ai-generated ai_generated aigenerated c2pa content_credentials contentcredentials created_with createdwith digital_source_type digitalsourcetype generator llm model provenance synthid".split()
IDENTITY_KEYS = "author authors byline contact coordinates created creator date email geo last_modified lastmod location modified".split()
AI_NAME = r"(?i)aigc|ai[-_ ]?generated|c2pa|content.?credential|digital.?source|generator|provenance|synthid|trainedalgorithmic"
VENDORS = r"(?:anthropic|bard|chatgpt|claude|copilot|dall.?e|firefly|gemini|gpt-[0-9]|llama|midjourney|mistral|openai|stable.?diffusion|synthid)"
AI_VENDOR = rf"(?i)(?<![A-Za-z0-9_]){VENDORS}(?![A-Za-z0-9_])"
AI_VENDOR_RE2 = rf"(?i)\b{VENDORS}\b"


def listed(view: str, needles: list[str]) -> str:
    """SQL: the needles that the view holds, comma-joined."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains({view}, '{n}') THEN '{n}' END" for n in needles) + ")"


def holds(view: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({view}, '{n}')" for n in needles) + ")"


def confidence(view: str) -> str:
    """SQL: how strongly the markers imply provenance; null without any."""
    return f"CASE WHEN {holds(view, CLAIMS)} THEN 'confirmed' WHEN {holds(view, PROVENANCE)} THEN 'probable' END"


RANK = "CASE {c} WHEN 'confirmed' THEN 3 WHEN 'probable' THEN 2 WHEN 'informational' THEN 1 WHEN 'likely-false-positive' THEN 0 END"
