"""Prepared actions (e-mail, call checklist), the per-client agent batch and the
templated answers.  Everything is a projection over one row per client or per
question; retrieval context is computed once per distinct question and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: e-mail subjects and body template
SUBJECT_HIGH = "On peut vous aider à relancer l’usage"
SUBJECT_OPTIMISE = "Optimiser encore votre usage"
SUBJECT_DEFAULT = "Point rapide sur votre usage"
EMAIL_TEMPLATE = (
    "Objet : %s\n\n"
    "Bonjour,\n\n"
    "Je vous contacte car nous avons observé des signaux d’usage qui méritent un point rapide.\n"
    "- Compte : %s\n"
    "- Plan : %s\n"
    "- Ville : %s\n"
    "- Niveau d’usage : %s\n"
    "- Risque churn : %s\n\n"
    "Proposition : un échange de 10 minutes pour identifier 1 action simple à appliquer cette semaine.\n\n"
    "Souhaitez-vous que je vous propose deux créneaux ?\n\n"
    "Cordialement,\n"
)

# fixed values: call checklist steps
URGENT_STEP = "Priorité élevée : traiter sous 24–48h."
BASE_STEPS = [
    "Confirmer le contexte (plan, usage, objectif principal).",
    "Qualifier le problème principal (1 phrase, mesurable).",
    "Identifier la cause probable (onboarding, valeur perçue, timing, friction).",
    "Proposer 1 action immédiate (simple, testable en 7 jours).",
    "Fixer un suivi (date + critère de succès).",
]
ACTIVATION_STEP = "Vérifier l’activation : quelles fonctionnalités sont réellement utilisées ?"
UPSELL_STEPS = [
    "Valider l’objectif business (ce que le client cherche à obtenir).",
    "Confirmer les usages forts (quelles features apportent le plus de valeur).",
    "Proposer une montée en gamme alignée (1 bénéfice clair, 1 objection anticipée).",
    "Offrir un essai / une option simple (si applicable).",
    "Fixer la prochaine étape (devis / upgrade / date de décision).",
]
NO_ACTION_MESSAGE = "Aucune action préparée"

# fixed values: action -> prepared action type (configurable routing table)
DEFAULT_ROUTES = {"send_retention_email": "email", "schedule_call": "call_plan", "proposer_upsell": "upsell_call_plan"}


def _txt(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _risk() -> Column:
    return F.coalesce(F.nullif(_txt("churn_risk"), F.lit("")), F.lit("medium"))


def _usage() -> Column:
    return F.coalesce(F.nullif(_txt("usage_level"), F.lit("")), F.lit("medium"))


def email_subject() -> Column:
    return (F.when(_risk() == "high", F.lit(SUBJECT_HIGH))
            .when((_risk() == "low") & (_usage() == "high"), F.lit(SUBJECT_OPTIMISE))
            .otherwise(F.lit(SUBJECT_DEFAULT)))


def email_text() -> Column:
    """The templated e-mail for a row with client_id, plan, ville, churn_risk, usage_level."""
    return F.format_string(EMAIL_TEMPLATE, email_subject(), F.trim(_txt("client_id")), F.trim(_txt("plan")),
                           F.trim(_txt("ville")), _usage(), _risk())


def checklist() -> Column:
    """Urgent step first when risk is high; activation step at index 3 when usage is low."""
    base = F.array(*[F.lit(s) for s in BASE_STEPS])
    lst = F.when(_risk() == "high", F.concat(F.array(F.lit(URGENT_STEP)), base)).otherwise(base)
    return F.when(_usage() == "low", F.array_insert(lst, 4, F.lit(ACTIVATION_STEP))).otherwise(lst)


def prepared_action(routes: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(type, payload text) from ``action`` through the routing table."""
    routes = routes or DEFAULT_ROUTES
    kind = F.lit("none")
    route = F.lit(None).cast("string")
    for action, r in routes.items():
        route = F.when(F.col("action") == action, F.lit(r)).otherwise(route)
    up = F.concat(F.array(*[F.lit(s) for s in UPSELL_STEPS]), checklist())
    payload = (F.when(route == "email", email_text())
               .when(route == "call_plan", F.array_join(checklist(), "\n"))
               .when(route == "upsell_call_plan", F.array_join(up, "\n"))
               .otherwise(F.lit(NO_ACTION_MESSAGE)))
    kind = (F.when(route == "email", F.lit("email"))
            .when(route.isin("call_plan", "upsell_call_plan"), F.lit("call_plan")).otherwise(F.lit("none")))
    return kind, payload


def agent_features(stats: DataFrame, revenue: DataFrame, scores: DataFrame) -> DataFrame:
    """Stats + revenue summary + churn prediction per client; missing parts flagged
    and defaulted like the reference tools (zeros, empty map, no date)."""
    rv = revenue.select("client_id", "total_amount", "events_count", "most_recent_date").withColumn("_rv", F.lit(True))
    sc = scores.select("client_id", "churn_probability", "churn").withColumn("_sc", F.lit(True))
    j = stats.join(rv, "client_id", "left").join(sc, "client_id", "left")
    return j.select(
        "client_id", "plan", "ville",
        F.coalesce("ca_total", F.lit(0.0)).alias("ca_total"),
        F.coalesce("nb_paiements", F.lit(0).cast("long")).alias("nb_paiements"),
        F.coalesce("sessions_total", F.lit(0).cast("long")).alias("sessions_total"),
        F.coalesce("total_amount", F.lit(0.0)).alias("revenue_total"),
        F.coalesce("events_count", F.lit(0).cast("long")).alias("revenue_events"),
        "most_recent_date", "churn_probability", "churn",
        F.coalesce("_rv", F.lit(False)).alias("has_revenue"),
        F.coalesce("_sc", F.lit(False)).alias("has_prediction"),
    )


# fixed values: answer templates (the one-shot playbook branch and the generic branch)
ONE_SHOT_MARKER = "Quand proposer"
ONE_SHOT = {
    "summary": "Vous pouvez proposer une prestation one-shot quand l’usage est fort et que le bénéfice est immédiat.",
    "why": ["Client actif (sessions/actions élevés).", "Besoin clair (support, intégration, formation).",
            "Ou opportunité détectée via l’historique one-shot (revenue_events)."],
    "action": "Proposer une prestation one-shot packagée (durée + livrable + bénéfice immédiat).",
    "prepared": ("Email prêt (à personnaliser) :\nObjet: Proposition rapide pour gagner du temps dès cette semaine\n\n"
                 "Bonjour,\nEn regardant votre usage, on voit une opportunité simple pour réduire vos frictions.\n"
                 "Je vous propose une prestation one-shot : [nom], durée [X], livrable [Y].\n"
                 "Si vous êtes d’accord, je vous envoie un créneau.\n"),
}
GENERIC = {
    "summary": "Je retrouve des éléments internes pour répondre et préparer une action.",
    "why": ["Réponse basée sur le corpus interne (règles + playbooks).", "Objectif : action simple, rapide, mesurable.",
            "Format non-tech, directement utilisable."],
    "action": "Appliquer le playbook le plus pertinent et préparer un message de contact.",
    "prepared": "Action préparée : brouillon email / checklist selon le playbook trouvé.",
}


def _answer(t: dict, confidence: Column, source: Column) -> Column:
    body = "\n".join(["## 1) Résumé", t["summary"], "", "## 2) Pourquoi", *[f"- {b}" for b in t["why"][:3]], "",
                      "## 3) Action recommandée", t["action"], "", "## 4) Action préparée", t["prepared"], "",
                      "## 5) Confiance", ""])
    src = F.when(F.length(F.coalesce(source, F.lit(""))) > 0, F.concat(F.lit("\n\n_Source: "), source, F.lit("_")))
    return F.concat(F.lit(body), confidence, F.coalesce(src, F.lit("")))


def answer_markdown(best_text: Column, source: Column, confidence: Column) -> Column:
    """5-section answer; template chosen by the best hit's text; confidence in
    {faible, moyen, fort}, anything else -> moyen."""
    conf = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    conf = F.when(conf.isin("faible", "moyen", "fort"), conf).otherwise(F.lit("moyen"))
    one = F.coalesce(F.trim(best_text).contains(ONE_SHOT_MARKER), F.lit(False))
    return F.when(one, _answer(ONE_SHOT, conf, source)).otherwise(_answer(GENERIC, conf, source))
