"""The shared inbox: who may see a conversation, its tabs, whose reply a mail is and what it stops; reservations with budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import views
from marlspike.operators.leads import greedy_duplicates
from marlspike.operators.mail import correlate
from marlspike.views import with_views

#: Enrollments that a reply stops, and messages that it can be the reply to.
OPEN_ENROLLMENTS, SENT = ("pending", "active", "sending", "held"), ("sent", "delivered", "opened", "clicked")


def access_scope(conversations: DataFrame, users: DataFrame, mailboxes: DataFrame, campaigns: DataFrame, contacts: DataFrame) -> DataFrame:
    """user_id, conv_id: conversations that a user may see: of an own mailbox or campaign (by id, name or address), of an own
    contact, or assigned to the user's id or address. One equi-join for each reason instead of one join with OR."""
    c, u = conversations, users
    owned = lambda key, owner: u.select("user_id", F.col(key).alias("_owner")).join(campaigns.select("campaign_id", F.col(owner).alias("_owner")), "_owner").select("user_id", "campaign_id")
    by_campaign = owned("user_id", "user_id").unionByName(owned("name", "owner")).unionByName(owned("email", "owner")).distinct()
    assigned = lambda key: u.select("user_id", F.col(key).cast("string").alias("assigned_to")).join(c, "assigned_to").select("user_id", "conv_id")
    reasons = [
        mailboxes.select("mailbox_id", "user_id").join(c, "mailbox_id"),
        by_campaign.join(c, "campaign_id"),
        contacts.select(F.col("id").alias("contact_id"), "user_id").join(c, "contact_id"),
        assigned("user_id"),
        assigned("email"),
    ]
    out = None
    for reason in reasons:
        pairs = reason.select("user_id", "conv_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.join(u.select("user_id"), "user_id", "left_semi").distinct()


def on_tab(tab: str) -> Column:
    """Whether a conversation stands on a tab of the inbox; any other name than those listed is a status."""
    listed = {"all": F.lit(True), "unread": F.col("unread") > 0, "replies": F.col("has_inbound"), "interested": F.col("interest") == "INTERESTED", "needs-action": F.col("status") == "NEEDS_ACTION"}
    return listed.get(tab, F.col("status") == tab)


def resolve_senders(replies: DataFrame, sent: DataFrame, emails: DataFrame) -> DataFrame:
    """reply_id, contact_id, via, message_id, received_s of each reply: by the sender's address, else the message that its header names, else
    the latest message to that address. sent: message_id, internet_id, provider_id, sent_s, contact_id, to_email, created_at.
    """
    named = correlate(replies.where("header is not null").select(F.col("reply_id").alias("inbound_id"), "header"), sent).select(F.col("inbound_id").alias("reply_id"), "message_id")
    named = named.join(sent.select("message_id", F.col("contact_id").alias("by_header")), "message_id")
    direct = emails.groupBy(F.col("normalized_email").alias("address")).agg(F.min("contact_id").alias("by_address"))
    latest = sent.groupBy(F.lower("to_email").alias("address")).agg(F.max(F.struct("created_at", "message_id", "contact_id"))["contact_id"].alias("by_latest"))
    joined = replies.withColumn("address", F.lower(F.trim("sender"))).join(direct, "address", "left").join(named, "reply_id", "left").join(latest, "address", "left")
    via = F.when(F.col("by_address").isNotNull(), "DIRECT_CONTACT_EMAIL").when(F.col("by_header").isNotNull(), "HEADER_THREAD").when(F.col("by_latest").isNotNull(), "RECENT_OUTBOUND_EMAIL").otherwise("NONE")
    return joined.select("reply_id", F.coalesce("by_address", "by_header", "by_latest").alias("contact_id"), via.alias("via"), "message_id", "received_s")


def outsiders(replies: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """Replies that don't come from one of the own mailboxes; without a sender they do."""
    own = mailboxes.select(F.lower("email").alias("_own")).distinct()
    there = replies.where(F.trim(F.coalesce("sender", F.lit(""))) != "")
    return there.join(own, F.lower(F.trim(there["sender"])) == own["_own"], "left_anti")


def handle_replies(resolved: DataFrame, enrollments: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """action, ref, contact_id, at: what replies (rows of resolve_senders) change, each once however often they are handled.

    stop: open enrollments of the contact, at its first reply, and the enrollment of the message that a header names. mark: a
    contact's n-th reply marks its n-th latest message that was sent and isn't marked yet. event: a replied event for
    each marked message that has none.
    """
    r = resolved.where("contact_id is not null")
    firsts = r.groupBy("contact_id").agg(F.min("received_s").alias("at"))
    by_contact = enrollments.where(F.col("status").isin(*OPEN_ENROLLMENTS)).join(firsts, "contact_id").select("id", "contact_id", "at")
    named = r.join(messages.select(F.col("id").alias("message_id"), "enrollment_id"), "message_id").groupBy(F.col("enrollment_id").alias("id")).agg(F.min("received_s").alias("at"))
    by_header = enrollments.where("status <> 'replied'").join(named, "id").select("id", "contact_id", "at")
    stops = by_contact.unionByName(by_header).groupBy(F.col("id").alias("ref"), "contact_id").agg(F.min("at").alias("at"))
    turn = F.row_number().over(Window.partitionBy("contact_id").orderBy("received_s", "reply_id"))
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy(F.desc("sent_at"), F.desc("id")))
    latest = messages.where(F.col("status").isin(*SENT)).join(firsts.select("contact_id"), "contact_id", "left_semi").withColumn("n", place).select("contact_id", "n", "id")
    marks = r.withColumn("n", turn).select("contact_id", "n", F.col("received_s").alias("at")).join(latest, ["contact_id", "n"])
    known = events.where("event_type = 'replied'").select(F.col("message_id").alias("id")).distinct()
    rows = lambda df, action, ref: df.select(F.lit(action).alias("action"), F.col(ref).cast("string").alias("ref"), "contact_id", "at")
    return rows(stops, "stop", "ref").unionByName(rows(marks, "mark", "id")).unionByName(rows(marks.join(known, "id", "left_anti"), "event", "id"))


def reserve(candidates: DataFrame, slots: DataFrame, budgets: DataFrame) -> DataFrame:
    """Plans of one tick: campaign_id, mailbox, id, place.

    Campaigns and their mailboxes are taken in order; a mailbox serves the first campaign that has candidates for it, with as
    many as its batch and what is left of the campaign's budget allow, follow-ups before new leads. What is decided in
    order is one row of counts for each campaign and mailbox of a tenant, never the candidates.
    candidates: campaign_id, mailbox, id, follow_up, due. slots: tenant, n (order), campaign_id, mailbox, batch. budgets: campaign_id, budget.
    """
    counts = candidates.groupBy("campaign_id", "mailbox").agg(F.count(F.lit(1)).alias("candidates"))
    rows = slots.join(counts, ["campaign_id", "mailbox"]).join(budgets, "campaign_id")
    in_order = rows.select("tenant", "n", "campaign_id", "mailbox", F.least("batch", "candidates").cast("long").alias("wanted"), F.col("budget").cast("long").alias("budget"))
    plans = _scanned(in_order.repartition("tenant").sortWithinPartitions("tenant", "n", "campaign_id", "mailbox"))
    place = F.row_number().over(Window.partitionBy("campaign_id", "mailbox").orderBy(F.desc("follow_up"), "due", "id"))
    return candidates.join(plans, ["campaign_id", "mailbox"]).withColumn("place", place).where("place <= size").select("campaign_id", "mailbox", "id", "place")


def _scanned(slots: DataFrame) -> DataFrame:
    """campaign_id, mailbox, size: one pass over each tenant's slots in order, which remembers what is left of its campaigns' budgets and
    which mailboxes serve; a slot's size depends on both, across campaigns."""
    import pyarrow as pa

    def run(batches):
        tenant, left, serving = None, {}, set()
        for batch in batches:
            out = ([], [], [])
            for t, campaign, mailbox, wanted, budget in zip(*[batch.column(c).to_pylist() for c in ("tenant", "campaign_id", "mailbox", "wanted", "budget")]):
                if t != tenant:
                    tenant, left, serving = t, {}, set()
                size = min(wanted or 0, left.setdefault(campaign, budget or 0))
                if size > 0 and mailbox not in serving:
                    left[campaign] -= size
                    serving.add(mailbox)
                    for column, value in zip(out, (campaign, mailbox, size)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["campaign_id", "mailbox", "size"])

    return slots.mapInArrow(run, "campaign_id long, mailbox long, size long")


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.message(spark, sf_dir)
    seconds = F.unix_micros(F.col("sent_at").cast("timestamp"))
    return m.select(F.col("id").alias("message_id"), F.concat(F.lit("<msg"), "id", F.lit("@mail.example>")).alias("internet_id"), F.concat(F.lit("provider-"), "id").alias("provider_id"), seconds.alias("sent_s"), "contact_id", "to_email", "created_at")


def p16_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_scope(views.conversation(spark, sf_dir), views.team(spark), views.mailbox(spark), views.campaign(spark), views.contact(spark, sf_dir))


def p15_inbox_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations on each tab, a status among them."""
    c = views.conversation(spark, sf_dir)
    out = None
    for tab in ("all", "unread", "replies", "interested", "needs-action", "CLOSED"):
        part = c.where(on_tab(tab)).agg(F.lit(tab).alias("tab"), F.count(F.lit(1)).alias("conversations"))
        out = part if out is None else out.unionByName(part)
    return out


def j11_sender_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose each reply is, and how that was found."""
    return resolve_senders(views.reply(spark, sf_dir), _sent(spark, sf_dir), views.contact_email(spark, sf_dir)).select("reply_id", "contact_id", "via")


def d12_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = outsiders(views.reply(spark, sf_dir), views.mailbox(spark))
    resolved = resolve_senders(replies, _sent(spark, sf_dir), views.contact_email(spark, sf_dir))
    return handle_replies(resolved, views.enrollment(spark, sf_dir), views.message(spark, sf_dir), views.event(spark, sf_dir))


def w05_first_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List members (by list and contact) whose contact and address no kept member before them has; a member of an odd list
    goes by its contact's second address, if any."""
    e = views.contact_email(spark, sf_dir)
    first, second = (e.groupBy("contact_id").agg(f("id", "normalized_email").alias("m")).select("contact_id", F.col("m").alias(n)) for f, n in ((lambda i, a: F.min_by(a, i), "first"), (lambda i, a: F.max_by(a, i), "second")))
    m = views.list_member(spark, sf_dir).join(first, "contact_id", "left").join(second, "contact_id", "left")
    rows = m.select((F.col("list_id") * 1_000_000 + F.col("contact_id")).alias("row_number"), "contact_id", F.when(F.col("list_id") % 2 == 1, F.col("second")).otherwise(F.col("first")).alias("address"))
    keys = F.array_compact(F.array(F.concat(F.lit("c:"), "contact_id"), F.concat(F.lit("e:"), "address")))
    gone = greedy_duplicates(rows.select("row_number", F.explode(keys).alias("key")))
    return rows.join(gone.select("row_number"), "row_number", "left_anti").select("row_number", "contact_id", "address")


def d09_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open enrollments over the mailboxes c, c + 2, c + 4 (of seven) of each campaign c, with batches and budgets."""
    n = views.enrollment(spark, sf_dir).where("status in ('active', 'pending')")
    box = (F.col("campaign_id") + F.col("contact_id") % 3 * 2) % views.MAILBOXES
    candidates = n.select("campaign_id", box.alias("mailbox"), "id", (F.col("current_step") > 1).alias("follow_up"), (F.col("contact_id") * 31 % 997).alias("due"))
    k, j = F.col("campaign_id"), F.col("j")
    slots = views.campaign(spark).select("campaign_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j")).select(F.lit(0).alias("tenant"), (k * 3 + j).alias("n"), "campaign_id", ((k + j * 2) % views.MAILBOXES).alias("mailbox"), (4 + k + j).alias("batch"))
    return reserve(candidates, slots, views.campaign(spark).select("campaign_id", "budget"))


QUERIES = {f.__name__: f for f in (p16_scope, p15_inbox_tabs, j11_sender_contact, d12_replies, w05_first_either, d09_reservation)}

_RESOLVED = """sender AS (SELECT reply_id, lower(sender) AS address, received_s, (SELECT m.id FROM message m WHERE lower(header) = '<msg' || m.id || '@mail.example>') AS message_id FROM reply),
resolved AS (SELECT s.*, (SELECT min(contact_id) FROM contact_email e WHERE e.normalized_email = s.address) AS by_address, (SELECT m.contact_id FROM message m WHERE m.id = s.message_id) AS by_header,
  (SELECT arg_max(m.contact_id, (m.created_at, m.id)) FROM message m WHERE lower(m.to_email) = s.address) AS by_latest FROM sender s)"""
ORACLES = {
    "p16_scope": with_views(
        "conversation team mailbox campaign contact",
        """SELECT DISTINCT u.user_id, c.conv_id FROM team u, conversation c WHERE c.mailbox_id IN (SELECT mailbox_id FROM mailbox m WHERE m.user_id = u.user_id)
  OR c.campaign_id IN (SELECT campaign_id FROM campaign g WHERE g.user_id = u.user_id OR g.owner = u.name OR g.owner = u.email) OR c.contact_id IN (SELECT id FROM contact k WHERE k.user_id = u.user_id) OR c.assigned_to = u.user_id::VARCHAR OR c.assigned_to = u.email""",
    ),
    "p15_inbox_tabs": with_views("conversation", "SELECT unnest(['all', 'unread', 'replies', 'interested', 'needs-action', 'CLOSED']) AS tab, unnest([count(*), count(*) FILTER (WHERE unread > 0), count(*) FILTER (WHERE has_inbound), count(*) FILTER (WHERE interest = 'INTERESTED'), count(*) FILTER (WHERE status = 'NEEDS_ACTION'), count(*) FILTER (WHERE status = 'CLOSED')]) AS conversations FROM conversation"),
    "j11_sender_contact": with_views("reply message contact_email", f"WITH {_RESOLVED} SELECT reply_id, coalesce(by_address, by_header, by_latest) AS contact_id, CASE WHEN by_address IS NOT NULL THEN 'DIRECT_CONTACT_EMAIL' WHEN by_header IS NOT NULL THEN 'HEADER_THREAD' WHEN by_latest IS NOT NULL THEN 'RECENT_OUTBOUND_EMAIL' ELSE 'NONE' END AS via FROM resolved"),
    "d12_replies": with_views(
        "reply message contact_email enrollment event mailbox",
        f"""WITH {_RESOLVED},
r AS (SELECT reply_id, coalesce(by_address, by_header, by_latest) AS contact_id, message_id, received_s FROM resolved WHERE coalesce(by_address, by_header, by_latest) IS NOT NULL AND address NOT IN (SELECT lower(email) FROM mailbox)),
s AS (SELECT n.id, n.contact_id, received_s FROM enrollment n JOIN r ON r.contact_id = n.contact_id WHERE status IN ('pending', 'active', 'sending', 'held')
  UNION ALL SELECT n.id, n.contact_id, received_s FROM enrollment n JOIN message m ON m.enrollment_id = n.id JOIN r ON r.message_id = m.id WHERE n.status <> 'replied'),
k AS (SELECT a.contact_id, a.received_s, m.id FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY received_s, reply_id) AS n FROM r) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY sent_at DESC, id DESC) AS n FROM message WHERE status IN ('sent', 'delivered', 'opened', 'clicked')) m ON m.contact_id = a.contact_id AND m.n = a.n)
SELECT 'stop' AS action, id AS ref, contact_id, min(received_s) AS "at" FROM s GROUP BY 2, 3 UNION ALL SELECT 'mark', id::VARCHAR, contact_id, received_s FROM k
UNION ALL SELECT 'event', id::VARCHAR, contact_id, received_s FROM k WHERE id NOT IN (SELECT message_id FROM event WHERE event_type = 'replied')""",
    ),
    # one member after the other
    "w05_first_either": with_views(
        "list_member contact_email",
        """WITH RECURSIVE a AS (SELECT contact_id, arg_min(normalized_email, id) AS first, arg_max(normalized_email, id) AS second FROM contact_email GROUP BY 1),
m AS (SELECT list_id * 1000000 + l.contact_id AS row_number, l.contact_id, CASE WHEN list_id % 2 = 1 THEN second ELSE first END AS address, row_number() OVER (ORDER BY list_id, l.contact_id) AS k FROM list_member l LEFT JOIN a ON a.contact_id = l.contact_id),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS contacts, []::VARCHAR[] AS addresses, NULL::BIGINT AS kept
  UNION ALL SELECT m.k, CASE WHEN hit THEN contacts ELSE list_append(contacts, m.contact_id) END, CASE WHEN hit OR m.address IS NULL THEN addresses ELSE list_append(addresses, m.address) END, CASE WHEN NOT hit THEN m.row_number END
  FROM (SELECT f.*, m.k AS next, list_contains(contacts, m.contact_id) OR coalesce(list_contains(addresses, m.address), false) AS hit FROM f JOIN m ON m.k = f.k + 1) x JOIN m ON m.k = x.next)
SELECT row_number, contact_id, address FROM m WHERE row_number IN (SELECT kept FROM f WHERE kept IS NOT NULL)""",
    ).replace("WITH list_member", "WITH RECURSIVE list_member").replace(",\n RECURSIVE a AS", ",\n a AS"),
    "d09_reservation": with_views(
        "enrollment campaign",
        """WITH c AS (SELECT campaign_id, (campaign_id + contact_id % 3 * 2) % 7 AS mailbox, id, current_step > 1 AS follow_up, contact_id * 31 % 997 AS due FROM enrollment WHERE status IN ('active', 'pending')),
t AS (SELECT campaign_id, mailbox, count(*) AS n FROM c GROUP BY 1, 2),
s AS (SELECT campaign_id, (campaign_id + j * 2) % 7 AS mailbox, budget, least(4 + campaign_id + j, t.n) AS wanted, row_number() OVER (ORDER BY campaign_id * 3 + j) AS k FROM campaign JOIN t USING (campaign_id), (SELECT unnest([0, 1, 2]) AS j) x WHERE t.mailbox = (campaign_id + j * 2) % 7),
f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS campaign_id, 0::BIGINT AS mailbox, []::BIGINT[] AS taken, 0::BIGINT AS used, 0::BIGINT AS size
  UNION ALL SELECT s.k, s.campaign_id, s.mailbox, CASE WHEN z > 0 THEN list_append(taken, s.mailbox) ELSE taken END, u + z, z
  FROM (SELECT f.taken, s.k AS next, CASE WHEN f.campaign_id = s.campaign_id THEN used ELSE 0 END AS u, CASE WHEN list_contains(taken, s.mailbox) THEN 0 ELSE greatest(0, least(wanted, budget - CASE WHEN f.campaign_id = s.campaign_id THEN used ELSE 0 END)) END AS z FROM f JOIN s ON s.k = f.k + 1) y JOIN s ON s.k = y.next)
SELECT campaign_id, mailbox, id, place FROM (SELECT c.*, row_number() OVER (PARTITION BY campaign_id, mailbox ORDER BY follow_up DESC, due, id)::INTEGER AS place FROM c) JOIN (SELECT campaign_id, mailbox, size FROM f WHERE size > 0) USING (campaign_id, mailbox) WHERE place <= size""",
    ).replace("WITH enrollment", "WITH RECURSIVE enrollment"),
}
