"""Word and phrase lists of the text-quality signals, in natural order."""

PHRASES_FR = [
    "dans un monde en constante évolution", "à l'ère du numérique", "de nos jours", "aujourd'hui plus que jamais", "il est important de noter", "il est essentiel de",
    "il convient de noter", "il convient de", "il est crucial de", "il est primordial de", "il est recommandé de", "force est de constater", "il va sans dire",
    "n'hésitez pas à", "que vous soyez", "en somme", "en définitive", "en conclusion", "pour conclure", "joue un rôle crucial", "joue un rôle essentiel",
    "joue un rôle clé", "faire appel à un professionnel", "grâce à son expertise", "en un rien de temps", "sans plus attendre", "plongeons", "explorons ensemble",
    "dans cet article", "cet article vous", "nous allons voir", "voyons maintenant", "passons maintenant", "penchons-nous", "guide complet", "tout ce qu'il faut savoir",
    "un large éventail", "une vaste gamme", "une large gamme", "un gage de", "la pierre angulaire", "un atout majeur", "une solution sur mesure",
    "répondre à vos besoins", "adapté à vos besoins", "adaptée à vos besoins", "selon vos besoins", "un excellent rapport qualité-prix",
    "prendre une décision éclairée", "des décisions éclairées", "en toute sérénité", "en toute tranquillité", "l'esprit tranquille", "un investissement judicieux",
    "ne cesse de croître", "en plein essor", "au cœur de", "à ne pas négliger", "à prendre en compte", "il ne faut pas oublier", "comme mentionné précédemment",
    "comme évoqué précédemment", "au fil des ans", "au fil du temps", "le monde du", "l'univers du", "l'univers de", "un véritable havre",
    "incontournable", "révolutionner", "optimiser votre", "maximiser votre", "sublimer", "un must", "une expérience unique", "une expérience optimale",
    "un choix judicieux", "la solution idéale", "le choix idéal", "quels que soient vos besoins", "dans les moindres détails",
    "vous garantit une", "des prestations de qualité", "un service de qualité", "un travail soigné", "un savoir-faire",
    "reste à votre disposition", "à votre disposition", "sur mesure", "haut de gamme", "d'exception", "en toute discrétion", "clé en main",
    "au service de", "prêt à vous", "en toute simplicité", "à votre écoute", "une expérience inoubliable", "un cadre idyllique", "vous accompagne",
    "nous mettons tout en œuvre", "à chaque instant", "dans les meilleures conditions",
]
PHRASES_EN = [
    "in today's fast-paced world", "in today's digital age", "delve into", "it's important to note", "it is worth noting", "in conclusion", "to sum up",
    "whether you're", "look no further", "a wide range of", "plays a crucial role", "seamlessly", "comprehensive guide", "unlock the", "elevate your", "embark on",
    "in the realm of", "navigating the", "ever-evolving", "game-changer", "harness the power", "dive into", "let's explore", "when it comes to",
    "at the end of the day", "needless to say", "stands out", "top-notch", "hassle-free", "peace of mind", "state-of-the-art", "cutting-edge",
    "tailored to your needs", "a testament to", "the landscape of", "tapestry", "treasure trove", "look no further than", "boasts", "meticulously",
]
WORDS_FR = """crucial cruciale cruciaux essentiel essentielle essentiels primordial primordiale incontournable incontournables optimal
optimale optimaux pléthore myriade innovant innovante novateur holistique synergie robuste exhaustif exhaustive
fluide harmonieusement judicieux judicieuse idéal idéale exceptionnel exceptionnelle remarquable inégalé inégalée
impeccable irréprochable notoire considérable significatif significative polyvalent polyvalente efficacement aisément
dédié dédiée dédiés dédiées hétéroclite hétéroclites prestations premium raffinement raffiné raffinée
ponctualité discrétion privatisé privatisée emblématique emblématiques prestigieux prestigieuse prisé prisée prisés""".split()
WORDS_EN = """crucial essential pivotal paramount plethora myriad innovative holistic synergy robust comprehensive seamless
effortlessly meticulous impeccable remarkable unparalleled versatile invaluable leverage streamline elevate unlock
foster empower transformative dynamic vibrant bespoke""".split()
CONNECTORS_FR = [
    "de plus", "en outre", "par ailleurs", "en effet", "ainsi", "cependant", "néanmoins", "toutefois", "enfin", "ensuite", "d'une part", "d'autre part",
    "en résumé", "en conclusion", "pour finir", "premièrement", "deuxièmement", "troisièmement", "notamment", "également", "en somme", "en définitive",
    "par conséquent", "de ce fait", "dès lors",
]
CONNECTORS_EN = [
    "additionally", "furthermore", "moreover", "however", "in addition", "finally", "firstly", "secondly", "overall", "ultimately", "consequently",
    "therefore", "nevertheless", "in conclusion", "in summary",
]
VAGUE_FR = [
    "de nombreux", "de nombreuses", "plusieurs", "divers", "diverses", "différents", "différentes", "un certain nombre", "la plupart",
    "généralement", "souvent", "parfois", "certains", "certaines", "il existe", "quelques", "beaucoup de", "toutes sortes",
]
VAGUE_EN = [
    "many", "numerous", "various", "several", "a number of", "most", "generally", "often", "sometimes", "some", "there are", "a lot of", "all kinds of", "countless",
]
ORAL_FR = [
    "bref", "franchement", "honnêtement", "du coup", "en vrai", "carrément", "vachement", "pas mal", "bah", "hein", "voilà", "j'avoue", "perso",
    "d'ailleurs", "au passage", "entre nous", "attention", "petit bémol", "bémol", "à mon avis", "je pense", "je trouve", "on va pas se mentir",
]
ORAL_EN = [
    "honestly", "frankly", "to be fair", "in my opinion", "i think", "i found", "personally", "by the way", "heads up", "full disclosure", "real talk",
]
FIRST_PERSON_FR = ["je ", "j'ai ", "j'avais", "mon expérience", "notre expérience", "nous avons testé", "j'ai testé", "on a testé", "chez nous"]
FIRST_PERSON_EN = ["i ", "i've ", "my experience", "we tested", "i tested", "in my"]
FRENCH_HITS = "le la les des une est pour dans".split()
ENGLISH_HITS = "the and for with this that are you".split()
SUPERLATIVES = "meilleur meilleure parfait parfaite idéal idéale exceptionnel incroyable inégalé best perfect amazing incredible ultimate".split()
CORPORATE = "vous vos votre nos notre you your our".split()
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre january february march april may june july august september october november december".split()
