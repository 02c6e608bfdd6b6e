"""Registered queries; importing a module of this package registers its queries in the catalog."""
