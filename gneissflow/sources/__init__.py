"""Tables read from Git work trees and commits."""
