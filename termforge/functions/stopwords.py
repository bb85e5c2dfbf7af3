"""Word lists of the annotator and the normaliser."""

from __future__ import annotations

# Words that no term holds.
NO_TERM_WORDS = (
    "are am be was were do did does had has have what which when where who how if whether an the this that these those is it its we our us they "
    "their them there then I he she my me his him her will shall may can cannot would should might could ought each every many much very more most "
    "than such several some both even and or but neither nor not never also much as well many e.g"
).split()
# Words that no term begins or ends with, mostly prepositions.
EDGE_WORDS = (
    "a am an and are as about above across after against along amid among around at been before behind below beneath beside besides between beyond by "
    "concerning considering despite do except excepting excluding for from had has have i in inside into if is it like my me of off on onto "
    "regarding since through to toward towards under underneath unlike until upon versus via with within without during what which when where who how "
    "whether"
).split()
# Words that normalize2 drops after stemming.
STEM_STOPS = "and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
