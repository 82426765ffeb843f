"""Part of lorecraft; see the modules."""
