"""General word lists for the offensive-content features, in English, German and Spanish.

Fixed values, one list per meaning: common insults, slurs and belittling words,
words that deny people their humanity, groups, sexual words, violence, parts of
the body, second person. They hold no vocabulary of a trade: which words about
machines or material are harmless, and which phrases are not, is learnt from
reviewed documents. Words are matched after disguises are undone; masked words
(``p****e``) match any word of a list with the same length and visible letters,
swapped letters match the word they come from.
"""

from __future__ import annotations

INSULT = """
idiot idiots moron morons cretin cretins imbecile imbeciles dimwit dimwits halfwit halfwits dumbass dumbasses asshole assholes arsehole shithead shitheads
bastard bastards prick pricks dickhead scumbag scumbags loser losers fool fools clown clowns jerk twat wanker bitch bitches whore whores slut sluts cunt
motherfucker fucker fuckers genius leech leeches worm worms pig pigs cockroach cockroaches degenerate degenerates parasite parasites retard retards
coward weasel trash halunke arschloch arschlöcher drecksack drecksau mistkerl mistkerle vollpfosten trottel versager wichser hurensohn schlampe fotze idioten
depp penner missgeburt nichtsnutz gusano payaso gilipollas idiota imbécil cabrón cabrones puta putas puto maricón hijoputa pendejo estúpido estúpida subnormal
""".split()  # fmt: skip
SLUR = """
stupid useless worthless pathetic spineless brainless braindead clueless miserable rotten filthy lazy ugly fat hideous disgusting dumb dirty incompetent
stink stinks smell smells strohdumm hirnlos hirnloser hirnlose wertloser wertlos fauler faul dumm dumme dummer erbärmlich inútil inútiles asqueroso vago tonto
""".split()
DEHUMANISE = """
vermin filth scum rats rat parasites apes ape animals garbage plague disease subhuman subhumans trash pest infestation breed multiply cockroaches leeches
abschaum ungeziefer dreckspack ratten pack gesindel basura ratas escoria plaga parásitos animales
""".split()
GROUP = """
women woman immigrants immigrant foreigners foreigner refugees refugee disabled gay gays lesbian lesbians muslims muslim jews jew christians blacks whites
migrants migrant gypsies frauen ausländer behinderte behinderten flüchtlinge schwule juden mujeres inmigrantes extranjeros gitanos discapacitados judíos
""".split()
SEXUAL = """
sex sexy nude nudes naked porn porno tits titties boobs boob breasts nipples cock cocks dick pussy ass arse horny lick licking suck fuck fucked fucking
screwing thighs moan moaned undress undressed undressing strip kinky blowjob orgasm cum erection titten ficken fick nackt geil muschi schwanz
brüste tetas follar follarte follo polla coño culo desnuda desnudo cachonda chupar
""".split()
THREAT = """
kill hurt smash break punch stab shoot burn drown hang die dead gun knife beat choke regret pay
umbringen töten erschießen schlagen brechen stechen matar mataré pegar romper
""".split()
BODY = "face arms arm jaw fingers teeth neck knees brain legs bones skull mouth eyes throat nase fresse kopf hals cara nariz boca dientes".split()
YOU = """
you your yours yourself yourselves u ur du dich dir dein deine deiner deinen euch eure ihr tu te ti tus eres contigo usted ustedes
""".split()
EXCLUDE = "out away belong allowed vote throw chased cage leash kitchen gehören raus weg fuera".split()

LISTS = {
    "insult": INSULT, "slur": SLUR, "dehumanise": DEHUMANISE, "group": GROUP, "sexual": SEXUAL,
    "threat": THREAT, "body": BODY, "you": YOU, "exclude": EXCLUDE,
}
#: Lists whose words are also looked for in masked and swapped spelling and inside long runs of letters.
DISGUISED = ("insult", "slur", "dehumanise", "sexual")
#: Lists whose words all stand for one another in learnt phrases.
TAGS = ("insult", "slur", "dehumanise", "group", "sexual")
