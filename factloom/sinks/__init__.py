"""Where finished rows go.

Every writer that belongs to a stream takes a batch id and replaces that batch's own folder, so a
batch that is repeated after a failure leaves one copy.
"""
