"""Fixed values. Results depend on these exact words, so they are stated as plain text."""

# --- fixed values: boilerplate words that make a short text noise ---
NOISE_WORDS = (
    "menu", "navigation", "cookies", "cookie", "rgpd", "gdpr", "cgu", "cgv", "mentions",
    "légal", "légales", "footer", "newsletter", "partage", "share", "social",
    "abonnez-vous", "publicité", "sponsor", "breadcrumb", "fil d'ariane", "compte",
    "connexion", "login", "inscription",
)

# --- fixed values: CSS selectors of the main content container, first match wins ---
MAIN_SELECTORS = (
    "#block-mainpagecontent", ".node__content", ".region--content", ".content__body",
    ".article-body", ".article-content", ".entry-content", ".post-content", ".content-area",
    ".single-content", ".content", ".elementor", ".elementor-section", "#topic", "main",
    "article", "[role=main]", "#content", "#main", ".main-content", ".page-content",
)

# --- fixed values: hosts whose PDF files may be read ---
PDF_HOSTS = (
    "has-sante.fr", "pour-les-personnes-agees.gouv.fr", "msdmanuals.com", "sfgg.org",
    "sfcardio.fr", "societe-francaise-neurovasculaire.fr", "splf.fr", "docs.splf.fr",
    "cancer.fr", "e-cancer.fr", "infectiologie.com", "lab-cerba.com",
    "documents.lab-cerba.com", "medg.fr", "recomedicales.fr",
)

# --- fixed values: file extensions a crawl never follows ---
BINARY_EXTENSIONS = (
    "pdf", "zip", "rar", "7z", "png", "jpg", "jpeg", "gif", "svg", "mp3", "mp4", "avi", "mov",
)

# --- fixed values: French stop words of the novelty measure (accents already removed) ---
STOP_WORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "au", "aux", "en", "dans", "sur", "sous",
    "avec", "et", "ou", "mais", "donc", "or", "ni", "car", "a", "pour", "par", "chez", "vers",
    "sans", "ce", "cet", "cette", "ces", "son", "sa", "ses", "leur", "leurs", "mon", "ma", "mes",
    "ton", "ta", "tes", "il", "elle", "ils", "elles", "on", "nous", "vous", "je", "tu", "y", "se",
    "d", "l", "qu", "n", "est", "sont", "ete", "etre", "fait", "faire", "peut", "peuvent", "doit",
    "doivent", "plus", "moins", "tres", "bien", "mal", "afin", "ainsi", "dont", "comme", "si",
)

# --- fixed values: small words kept lower-case inside a French title ---
TITLE_SMALL_WORDS = ("de", "du", "des", "d", "la", "le", "les", "aux", "au", "et", "ou")

# --- fixed values: keywords of each dialogue intent ---
INTENT_KEYWORDS = {
    "generate_ppa": (
        "plan d'accompagnement", "ppa", "générer un ppa", "objectifs et actions",
        "proposer un plan", "élaborer un ppa", "plan personnalisé", "préparer le plan",
        "faire un plan pour le patient", "créer un plan", "rédiger le plan",
        "plan à mettre en place", "plan à faire", "prévois un accompagnement",
        "plan du patient", "mettre en place le suivi", "organiser le plan de soins",
        "définir un plan", "construire le plan",
    ),
    "get_constants": (
        "constantes", "tension", "poids", "température", "fréquence cardiaque", "graphique",
        "affiche les constantes", "évolution", "valeurs biologiques", "données de santé",
        "historique médical", "voir les courbes", "montre moi les constantes",
        "valeurs mesurées", "graphique du patient", "état de santé", "résumé médical",
        "suivi des constantes", "affiche les mesures", "statistiques de santé",
        "courbe de poids", "tendance médicale",
    ),
    "generate_recommendations": (
        "conduite à tenir", "prise en charge", "recommandations", "quoi faire", "traitement",
        "agir", "soins à apporter", "prévention", "risque", "urgence", "aide pour un cas",
        "prise de décision", "avis médical", "diagnostic", "que faire",
        "quelle démarche suivre", "comment réagir", "que dois-je faire",
        "orientation médicale", "décision médicale", "protocole à suivre",
        "réponse adaptée", "conseils de soins", "suggestion d’action",
        "mesures à prendre", "plan d’action à suivre",
    ),
}

# --- fixed values: which intent wins when several match ---
INTENT_PRIORITY = {"get_constants": 1, "generate_ppa": 2, "generate_recommendations": 3}

# --- fixed values: answers that confirm a pending request ---
YES_ANSWERS = ("oui", "yes", "ok", "o", "y", "c'est bien ça")

# --- fixed values: strings that count as an empty record value ---
EMPTY_MARKERS = ("", "non renseigné", "null")
NOT_GIVEN = "Non renseigné"

# --- fixed values: normalised tokens that tell a gender ---
MALE_TOKENS = ("m", "h", "homme", "mr", "monsieur", "masculin", "male", "mister")
FEMALE_TOKENS = ("f", "femme", "mme", "madame", "mlle", "melle", "mademoiselle", "feminin", "female")

# --- fixed values: day columns, slot rows and the moment-to-slot rule of the weekly schedule ---
WEEK_DAYS = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")
SLOTS = (
    "8h00-9h30", "10h00-11h00", "12h00-13h00", "14h00-15h30",
    "16h00-17h00", "18h00-19h30", "20h00-21h00", "nuit",
)
MOMENT_SLOTS = {
    "Lever": "8h00-9h30",
    "Matin": "10h00-11h00",
    "Midi": "12h00-13h00",
    "Déjeuner": "12h00-13h00",
    "Après-midi": "14h00-15h30",
    "Fin d’après-midi": "16h00-17h00",
    "Goûter": "16h00-17h00",
    "Soir": "18h00-19h30",
    "Coucher": "20h00-21h00",
    "Nuit": "nuit",
}

# --- fixed values: normal range of each vital sign ---
VITAL_RANGES = {
    "poids": (45.0, 100.0),
    "température": (36.0, 38.0),
    "tension_sys": (90.0, 140.0),
    "tension_dia": (60.0, 90.0),
}
